"""Same or near-same records across splits.

Records are canonicalised (case folded, everything but letters and digits a space, passages sorted) and hashed; records of
one hash are one class, and evaluation classes are joined with training classes: the hash itself finds exact copies. Near
copies are found by the hashes of the five-word shingles of the canonical text, winnowed: of every four in a row the least, so
that eight words in a row in common are a common key. Only keys that both sides have can link; of those a class keeps its rarest, so many that two classes sharing ``SHARED`` of them must meet in one kept key (prefix
filter, no cap on partners). A key that many classes have (a stock passage) is joined together with a word of the query: two records
are the same only if they share ``SAME_QUERY`` of their queries' words, so they share one of the rarest of them, by the same prefix
filter, and a group of any size falls apart without losing a pair. A bit signature of the query is compared inside these joins, before
any pair is stored, and what is left is verified on the words of both records.

Defined results: case and outer spaces of the split do not matter, splits other than those named take no part; null queries and
passages are empty; records without any word match nothing; repeated rows count once; empty tables give empty results.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize
from quernstone.plans.skew import HOT_PARTS, salted_join
from quernstone.sources.tables import table

SHINGLE = 5
#: Of each run of so many shingles the least hash is kept, so any eight words in a row that two records share give a common key.
WINDOW = 4
#: Two near-same records share at least this part of the shingles by which either could meet the other side.
SHARED = 0.7
#: A key with more classes than this is joined with words of the query besides. It changes the plan only, not the result.
MANY = 256
#: Least part of the words of the longer query, and of the longer set of passages, that the other record has too.
SAME_QUERY, SAME_TEXT = 0.6, 0.7


def canonical(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of the runs of n words; of a shorter text, one hash of the whole. ``words`` is best a column or a lambda's
    variable: as an expression it would be worked out again for every run."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def winnowed(hashes: Column, w: int = WINDOW) -> Column:
    """The least hash of every w neighbours: texts with w shingles in a row in common have one of these in common."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - F.lit(w - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, w))))


def _bits(text: Column) -> Column:
    """64 bits, one set for each word."""
    return F.aggregate(F.split(text, " "), F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))


def query_words(queries: DataFrame) -> DataFrame:
    """``queries`` (k, cq) to (k, w): the rarest words of each query, so many that two queries which share ``SAME_QUERY`` of the words of
    the longer one share one of these. A word that stands twice is two; a blank query has one blank word."""
    own = F.array_sort(F.split("cq", " "))
    numbered = F.transform("ws", lambda w, i: F.concat(w, F.lit("#"), (i - F.array_position("ws", w) + 1).cast("string")))
    each = queries.select("k", own.alias("ws")).select("k", F.explode(numbered).alias("w"))
    df = each.groupBy("w").agg(F.count(F.lit(1)).alias("n_w"))
    part = Window.partitionBy("k")  # the words of one query
    ranked = each.join(df, "w").withColumn("r", F.row_number().over(part.orderBy("n_w", "w"))).withColumn("m", F.count(F.lit(1)).over(part))
    return materialize(ranked.where(F.col("r") <= F.col("m") - F.ceil(F.col("m") * SAME_QUERY) + 1).select("k", "w"), "query-words")


def _overlap(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    return sum((Counter(x) & Counter(y)).values()) / max(1, len(x), len(y))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [
            (not (q or r) or _overlap(q, r) >= SAME_QUERY) and (not (p or s) or _overlap(p, s) >= SAME_TEXT)
            for q, r, p, s in zip(b["t_query"], b["e_query"], b["t_text"], b["e_text"])
        ]
        yield b.loc[ok, ["t_class", "e_class"]].set_axis(["t", "e"], axis=1)


def cross_split_pairs(records: DataFrame, train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """``records`` (id string, split, query, passages array<string>) to distinct (train_id, eval_id, exact)."""
    split = F.lower(F.trim("split"))
    side = F.when(split.isin(*train), "t").when(split.isin(*held_out), "e")
    r = records.select(F.col("id").cast("string").alias("id"), side.alias("side"), canonical(F.col("query")).alias("cq"), F.array_sort(F.filter(F.transform(F.coalesce("passages", F.array().cast("array<string>")), canonical), lambda p: p != "")).alias("cp"))
    r = r.where("side IS NOT NULL AND id IS NOT NULL AND (cq <> '' OR size(cp) > 0)")
    r = r.withColumn("class", F.unhex(F.md5(F.concat_ws("\u0001", "cq", F.array_join("cp", "\u0002")))))
    members = materialize(r.select("id", "side", "class").distinct(), "members")
    reps = materialize(r.groupBy("class").agg(F.first("cq").alias("cq"), F.first("cp").alias("cp"), F.max((F.col("side") == "t").cast("int")).alias("nt"), F.max((F.col("side") == "e").cast("int")).alias("ne")), "classes")

    parts = F.transform(F.filter(F.array_union(F.array("cq"), F.col("cp")), lambda t: t != ""), lambda t: F.split(t, " "))
    keys = F.transform(F.transform(parts, lambda p: shingles(p)), lambda s: winnowed(s))  # a function of two arguments would get the index
    # the key stages know a class by 64 bits; should two classes share them, both are verified
    each = reps.select(F.xxhash64("class").alias("k"), (F.col("nt") + 2 * F.col("ne")).cast("byte").alias("sides"), _bits(F.col("cq")).alias("bits"), F.explode(F.array_distinct(F.flatten(keys))).alias("h"))
    has = lambda side: F.max((F.col("sides").bitwiseAND(side) > 0).cast("byte"))
    df = each.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df"), has(1).alias("in_t"), has(2).alias("in_e")).where("in_t > 0 AND in_e > 0").select("h", "df")
    df = materialize(df, "document-frequencies")
    most = df.agg(F.sum("df")).first()[0] or 0
    hot = [(r["h"],) for r in df.where(F.col("df") > max(most / HOT_PARTS, 1000)).select("h").collect()]  # fewer than HOT_PARTS
    can = salted_join(each, df, "h", hot=hot)
    own = Window.partitionBy("k")
    kept = can.withColumn("r", F.row_number().over(own.orderBy("df", "h"))).withColumn("m", F.count(F.lit(1)).over(own))
    kept = materialize(kept.where(F.col("r") <= F.col("m") - F.ceil(F.col("m") * SHARED) + 1).select("k", "sides", "bits", "h", (F.col("df") > MANY).alias("many")), "keys")
    crowded = kept.where("many")
    words = query_words(reps.select(F.xxhash64("class").alias("k"), "cq").join(crowded.select("k").distinct(), "k", "left_semi"))
    keyed = kept.where("NOT many").select("k", "sides", "bits", F.xxhash64("h").alias("h")).unionByName(crowded.join(words, "k").select("k", "sides", "bits", F.xxhash64("h", "w").alias("h")))
    t = keyed.where("sides <> 2").select("h", F.col("k").alias("t"), F.col("bits").alias("tb"))
    e = keyed.where("sides <> 1").select("h", F.col("k").alias("e"), F.col("bits").alias("eb"))
    # words in common set bits in common: the bits test passes whatever the exact test on words would pass
    alike = F.bit_count(F.col("tb").bitwiseAND(F.col("eb"))) >= 0.6 * SAME_QUERY * F.greatest(F.bit_count("tb"), F.bit_count("eb"))
    near = materialize(salted_join(t, e, "h").where((F.col("t") != F.col("e")) & alike).select("t", "e").distinct(), "near")
    text = lambda c: reps.select(F.xxhash64("class").alias(c), F.col("class").alias(f"{c}_class"), F.col("cq").alias(f"{c}_query"), F.array_join("cp", " ").alias(f"{c}_text"))
    checked = near.join(text("t"), "t").join(text("e"), "e").select("t_class", "t_query", "t_text", "e_class", "e_query", "e_text").mapInPandas(_verify, "t binary, e binary")
    same = reps.where("nt = 1 AND ne = 1").select(F.col("class").alias("t"), F.col("class").alias("e"))
    classes = materialize(checked.unionByName(same), "pairs")
    left = members.where("side = 't'").select(F.col("class").alias("t"), F.col("id").alias("train_id"))
    right = members.where("side = 'e'").select(F.col("class").alias("e"), F.col("id").alias("eval_id"))
    pairs = salted_join(salted_join(left, classes, "t"), right, "e")
    return pairs.select("train_id", "eval_id", (F.col("t") == F.col("e")).alias("exact")).where("train_id <> eval_id").distinct()


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gold_instances")
    return cross_split_pairs(g.select(F.col("instance_id").alias("id"), "split", "query", F.col("passages.text").alias("passages")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of instances, one in train and one in dev or test, that are the same record."""
    return gold_pairs(spark, sf_dir).select(F.least("train_id", "eval_id").alias("instance_a"), F.greatest("train_id", "eval_id").alias("instance_b")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split of the held-out record and per source type of its passages."""
    g = table(spark, sf_dir, "gold_instances").select(F.col("instance_id").alias("eval_id"), F.lower(F.trim("split")).alias("split"), F.explode_outer(F.array_distinct("passages.source_type")).alias("source_type")).distinct()
    pairs = gold_pairs(spark, sf_dir)
    per = pairs.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact").cast("bigint")).alias("n_exact"))
    return g.join(per, "eval_id").groupBy("split", "source_type").agg(F.count_distinct("eval_id").alias("n_instances"), F.sum("n").alias("n_pairs"), F.sum("n_exact").alias("n_exact_pairs"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES: dict[str, str] = {}
