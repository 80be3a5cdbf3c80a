"""Mixing sources to target weights, by Pareto order sampling.

Sizes are tokens of a public tokenizer. A source's target is its share of the tokens of all documents. What fits as whole
copies of all its documents (at most ``max_repeats``) is allocated outright; of the rest a sample is drawn without
replacement: a document has inclusion probability p = min(1, c * sqrt(tokens)), c such that the expected tokens are the rest;
documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u a hash of the document, and the first in that order whose tokens
come nearest to the rest are taken. Ranks are found by counting tokens in ``BUCKETS`` ranges of the order, and by sorting only
the range in which the rest runs out, so no source is ever sorted in one task.

Defined results: null and empty texts have 0 tokens; documents with a null source or one without target count into the total
but are not used; a document delivered twice counts once; sources without documents fall short; empty tables give one row for
each target with nothing reached.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize
from quernstone.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
#: Size classes per doubling of tokens, for solving c; there are at most 64 * CLASSES of them for a source.
CLASSES = 32


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``documents`` (doc_id, source, text) to (doc_id, source, n_tokens). The vocabulary file is read on the driver and
    sent to the workers (under 1 MB)."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    kind = documents.schema["doc_id"].dataType.simpleString()
    pattern = PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": pd.Series(n, dtype="int64")})

    return documents.select("doc_id", "source", "text").mapInPandas(run, f"doc_id {kind}, source string, n_tokens bigint")


def allocate(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target: (source, target_share, max_repeats, own, want, copies, rest, short)."""
    total = F.broadcast(sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")))  # one row
    own = sizes.groupBy("source").agg(F.sum("n_tokens").alias("own"), F.count(F.lit(1)).alias("n_documents"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    a = t.join(own, "source", "left").fillna(0, ["own", "n_documents"]).crossJoin(total).withColumn("want", F.col("target_share") * F.col("total"))
    short = (F.col("own") == 0) | (F.col("want") > F.col("max_repeats") * F.col("own"))
    copies = F.when(short, F.col("max_repeats")).otherwise(F.floor(F.try_divide("want", F.col("own").cast("double")))).cast("int")
    a = a.withColumn("short", short).withColumn("copies", copies)
    return a.withColumn("rest", F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("want") - F.col("copies") * F.col("own")))


def _rates(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, c): the factor of sqrt(tokens) for which the expected sample has the rest. Solved on size classes."""
    klass = F.floor(F.log2("n_tokens") * CLASSES)
    rows = (
        sizes.where("n_tokens > 0").join(F.broadcast(plan.where("rest > 0").select("source", "rest")), "source")  # a row for each target
        .groupBy("source", "rest", klass.alias("k")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.sqrt("n_tokens")).alias("wt"))
    )
    out = []
    by: dict[str, list] = {}
    for r in rows.collect():  # at most 64 * CLASSES rows for each target
        by.setdefault(r["source"], []).append(r)
    for source, own in by.items():
        own.sort(key=lambda r: -r["wt"] / r["t"])
        sure, left = 0.0, sum(r["wt"] for r in own)
        c = 0.0
        for r in own:  # classes whose probability would pass 1 are taken whole
            c = (own[0]["rest"] - sure) / left if left > 0 else 0.0
            if c * r["wt"] / r["t"] <= 1:
                break
            sure += r["t"]
            left -= r["wt"]
        out.append((source, max(c, 0.0)))
    return sizes.sparkSession.createDataFrame(out, "source string, c double")


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document used at least once."""
    rates = _rates(sizes, plan)
    d = sizes.join(F.broadcast(plan.select("source", F.col("copies").alias("whole"), "rest")), "source").join(F.broadcast(rates), "source", "left")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    p = F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)) * F.sqrt("n_tokens"))
    d = d.withColumn("p", p).withColumn("q", F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))))
    d = d.withColumn("bucket", F.floor(F.lit(BUCKETS) * F.col("q") / (1 + F.col("q"))))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = d.where("bucket IS NOT NULL").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))  # at most BUCKETS rows for a source
    edge = before.where("before < rest").groupBy("source").agg(F.max("bucket").alias("edge"), F.max_by("before", "bucket").alias("before"))
    d = d.join(F.broadcast(edge), "source", "left")  # a row for each target
    last = d.where("bucket = edge")
    run = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # one bucket of a source
    last = last.withColumn("at", F.col("before") + F.sum("n_tokens").over(run)).where(F.col("at") - F.col("n_tokens") / 2 <= F.col("rest"))
    sampled = d.where("bucket < edge").select("doc_id", "source", "n_tokens", "whole").unionByName(last.select("doc_id", "source", "n_tokens", "whole"))
    drawn = sampled.select("doc_id", F.lit(1).alias("extra"))
    used = d.select("doc_id", "source", "n_tokens", "whole").join(drawn, "doc_id", "left")
    return used.select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")).where("copies > 0")


def _sizes(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer).where("doc_id IS NOT NULL")
    return materialize(counted.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "sizes")


def p7_mix(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents of the mix and how often each is used."""
    sizes = _sizes(spark, sf_dir, tokenizer)
    return mix(sizes, materialize(allocate(sizes, table(spark, sf_dir, "mix_targets")), "plan"))


def reached(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each target with what the drawn mix holds of it. A source falls short if the mix holds fewer tokens of it than its
    target although every document is used as often as it may be."""
    got = mix(sizes, plan).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    out = plan.drop("short").join(got, "source", "left").fillna(0, ["n_tokens", "n_copies", "most_copies"])
    spent = F.col("n_copies") >= F.col("n_documents") * F.greatest("max_repeats", F.lit(0))
    every = Window.partitionBy(F.lit(0))  # a row for each target
    return out.select(
        "source", "target_share", "max_repeats", "n_documents", "n_tokens", "n_copies", "most_copies",
        ((F.col("own") == 0) | spent & (F.col("n_tokens") < F.col("want"))).alias("short"),
        F.try_divide("n_tokens", F.sum("n_tokens").over(every)).alias("share"), F.try_divide("n_tokens", "total").alias("share_of_all"),
    )


def p7_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per source: its target and the share really reached."""
    sizes = _sizes(spark, sf_dir, tokenizer)
    return reached(sizes, materialize(allocate(sizes, table(spark, sf_dir, "mix_targets")), "plan"))


def p7_found(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sources that fall short of their target in the mix that was drawn."""
    return p7_shares(spark, sf_dir, tokenizer).where("short").select("source")


QUERIES = {"p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares}
# SQL has no tokenizer; sources fall short, or do not, by a wide margin in any unit of size, so letters stand for tokens here
ORACLES = {
    "p7_found": """
WITH d AS (SELECT doc_id, max(source) AS source, max(length(text)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
o AS (SELECT source, sum(n) AS own FROM d GROUP BY source), t AS (SELECT source, max(target_share) AS share, max(max_repeats) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY source)
SELECT source FROM t LEFT JOIN o USING (source) WHERE coalesce(own, 0) = 0 OR share * (SELECT sum(n) FROM d) > most * own
"""
}
