"""Pairs of passages: candidate joins, lexical features, a deterministic entailment stand-in and scores."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.plans.materialize import materialize


# Figures and years in a passage, and words that negate it.
NUMBER, FIGURE, YEAR = r"(\d+(?:[.,]\d+)?\s*%?)", r"(\d+(?:\.\d+)?%?)", r"\b((?:19|20)\d{2})\b"
NEGATIONS = "not no never cannot won't doesn't does may prohibited excluded waived exempt denied".split()


def found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.rtrim(x)))


def clash(a: Column, b: Column) -> Column:
    """Both sets have something, and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def features(a: Column, b: Column) -> dict[str, Column]:
    """Lexical features of two texts: cues of either and their difference, qualifiers, lengths, figures, years, words in common.
    Order of the two does not matter but for the columns that name one."""
    cue = lambda c: (T.cue_count(a, c), T.cue_count(b, c))
    (ea, eb), (ra, rb), (ta, tb), (oa, ob) = map(cue, (T.EXCEPTION_CUES, T.RESTRICTION_CUES, T.TEMPORAL_CUES, T.OPINION_CUES))
    qa, qb = T.qualifiers(a), T.qualifiers(b)
    na, nb, ya, yb = found(a, NUMBER), found(b, NUMBER), found(a, YEAR), found(b, YEAR)
    wa, wb = F.greatest(T.word_count(a), F.lit(1)), F.greatest(T.word_count(b), F.lit(1))
    return {
        "exception_cues_i": ea, "exception_cues_j": eb, "exception_cues_max": F.greatest(ea, eb), "exception_cues_asymmetry": F.abs(ea - eb),
        "restriction_cues_i": ra, "restriction_cues_j": rb, "restriction_asymmetry": F.abs(ra - rb),
        "qualifiers_i": qa, "qualifiers_j": qb, "specificity_asymmetry": F.abs(qa - qb), "length_ratio": F.round(F.least(wa, wb) / F.greatest(wa, wb), 9),
        "numeric_overlap": F.round(T.jaccard(na, nb), 9), "numeric_clash": clash(na, nb).cast("bigint"),
        "year_clash": ((F.size(ya) > 0) & (F.size(yb) > 0) & (F.array_sort(ya) != F.array_sort(yb))).cast("bigint"),
        "temporal_cues_max": F.greatest(ta, tb), "opinion_cues_max": F.greatest(oa, ob), "token_jaccard": F.round(T.jaccard(T.words_of(a), T.words_of(b)), 9),
    }


# Fixed values: (entailment, neutral, contradiction) of each case of the lexical stand-in.
TRIPLES = {"blank": (0.0, 1.0, 0.0), "figures": (0.05, 0.15, 0.80), "polarity": (0.10, 0.25, 0.65), "covered": (0.75, 0.20, 0.05), "related": (0.25, 0.65, 0.10), "unrelated": (0.05, 0.90, 0.05)}


def heuristic_entailment(premise: Column, hypothesis: Column) -> Column:
    """struct(entailment, neutral, contradiction) where no model's scores are at hand; models join scores in its place."""
    s = lambda k: F.struct(*[F.lit(v).alias(n) for v, n in zip(TRIPLES[k], ("entailment", "neutral", "contradiction"))])
    p, h = T.words_of(premise), T.words_of(hypothesis)
    overlap = T.containment(h, p)
    negated = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, NEGATIONS)))
    return (
        F.when((F.size(p) == 0) | (F.size(h) == 0), s("blank")).when(clash(found(premise, FIGURE), found(hypothesis, FIGURE)) & (overlap > 0.3), s("figures"))
        .when((negated(p) != negated(h)) & (overlap > 0.3), s("polarity")).when(overlap > 0.7, s("covered")).when(overlap > 0.35, s("related")).otherwise(s("unrelated"))
    )


def conflict_signal(nli: Column) -> Column:
    return nli["contradiction"] + 0.25 * nli["neutral"]


def rule_score(nli: Column, f: dict[str, Column]) -> Column:
    """Probability of a conflict from the entailment scores and the features, in [0, 1]."""
    half = lambda c: F.least(F.lit(1.0), c / 2)
    raw = 0.6 * conflict_signal(nli) + 0.2 * half(f["exception_cues_max"]) + 0.1 * half(f["restriction_asymmetry"]) + 0.15 * f["numeric_clash"] + 0.1 * f["year_clash"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (0.35 + 0.65 * F.least(F.lit(1.0), 3 * f["token_jaccard"]))))


def rule_relation(f: dict[str, Column]) -> Column:
    """The four-way relation guessed from surface cues."""
    return (
        F.when(f["token_jaccard"] < 0.2, "disjoint").when((f["numeric_clash"] == 0) & (f["exception_cues_max"] == 0), "redundant")
        .when((f["restriction_asymmetry"] >= 1) | (f["specificity_asymmetry"] >= 2), "refinement").otherwise("opposed")
    )


def rule_type(f: dict[str, Column]) -> Column:
    """The conflict type guessed from surface cues: time and opinion first, then scope, then figures."""
    scoped = (f["exception_cues_max"] >= 1) | ((f["restriction_asymmetry"] >= 1) & (f["specificity_asymmetry"] >= 1))
    return (
        F.when((f["temporal_cues_max"] >= 1) & ((f["year_clash"] > 0) | (f["numeric_clash"] > 0)), "temporal").when(f["opinion_cues_max"] >= 1, "opinion")
        .when(scoped, "conditional").when((f["numeric_clash"] > 0) | (f["token_jaccard"] > 0.45), "factual").otherwise("no_conflict")
    )


def alive_in_order(ids: Column, contradicts) -> Column:
    """A fold over an array in rank order: what contradicts an earlier one that is still kept is dropped. ``contradicts(i, j)``."""
    return F.aggregate(ids, F.array().cast("array<string>"), lambda kept, j: F.when(F.exists(kept, lambda i: contradicts(i, j)), kept).otherwise(F.array_append(kept, j)))


def passage_pairs(records: DataFrame) -> DataFrame:
    """``records`` (instance_id, passages) to unordered pairs (instance_id, doc_i < doc_j, text_i, text_j): pairs inside a record
    are made in its own array, without a join."""
    p = F.filter("passages", lambda x: x["id"].isNotNull())
    one = records.select("instance_id", p.alias("p"))
    each = one.select("instance_id", F.explode("p").alias("x"), "p").select("instance_id", "x", F.explode("p").alias("y")).where("x.id < y.id")
    return each.select("instance_id", F.col("x.id").alias("doc_i"), F.col("y.id").alias("doc_j"), F.coalesce("x.text", F.lit("")).alias("text_i"), F.coalesce("y.text", F.lit("")).alias("text_j"), F.col("x.source_type").alias("type_i"), F.col("y.source_type").alias("type_j"))


#: Tokens that a candidate pair of sets must share among the rare ones of both.
SHARED = 4


def subsets(tokens: Column, k: int) -> Column:
    """The subsets of k of an array's tokens, each in the array's order."""
    if k == 1:
        return F.transform(tokens, lambda x: F.array(x))
    rest = lambda x, i: F.transform(subsets(F.slice(tokens, i + 2, F.size(tokens)), k - 1), lambda y: F.concat(F.array(x), y))
    return F.flatten(F.transform(tokens, rest))


def similar_sets(sets: DataFrame, key: str, tokens: str, threshold: float, copies: bool = False) -> DataFrame:
    """Pairs (a < b, common, jaccard) of rows whose token sets reach the Jaccard ``threshold``, exactly.

    Prefix filter: tokens are ordered from rare to common, and two sets that similar share m tokens among the first
    n - ceil(threshold * n) + m of each, for every m they have in common. Unequal sets so similar have at least
    threshold / (1 - threshold) in common, so m is that, ``SHARED`` at most, and sets meet by m tokens together. Of those that
    meet, 64 bits of each set tell most that differ in too many tokens before a pair is kept. Equal
    sets are one class, so copies do not meet each other, and a class has a number till its pairs are known. With ``copies`` each row of
    a class is then paired with each of the other and of its own, so all pairs of rows are returned; without, a class is returned by its
    least key. The keys of a class are one array: m of them give m * (m - 1) / 2 pairs, so it is small beside the result.
    """
    near = 1e-9  # of products and quotients that should be whole
    m = max(1, min(SHARED, math.ceil(threshold / (1 - threshold) - near))) if threshold < 1 else SHARED
    s = sets.where(F.size(tokens) > 0).select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("t")).groupBy("t").agg((F.collect_set("k") if copies else F.array(F.min("k"))).alias("ks"))
    s = materialize(s.withColumn("id", F.monotonically_increasing_id()), "sets")
    each = s.select("id", F.size("t").alias("n"), F.explode("t").alias("w"))
    df = each.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(df, "w").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    first = F.col("n") - F.ceil(F.col("n") * threshold - near).cast("int") + m - (F.col("n") - F.size("r"))  # a token of one set alone stands before all others
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x["w"]), F.lit(64)).cast("int"))
    bits = F.aggregate("r", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x)))
    head = ranked.select("id", "n", (F.col("n") - F.size("r")).alias("own"), bits.alias("bits"), F.slice(F.transform("r", lambda x: x["w"]), 1, F.greatest(first, F.lit(0))).alias("p"))
    head = head.select("id", "n", "own", "bits", F.explode(F.transform(subsets(F.col("p"), m), lambda x: F.xxhash64(x))).alias("h"))
    a, b = [head.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("own").alias(f"own{c}"), F.col("bits").alias(f"bits{c}"), "h") for c in "ab"]
    alike = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - near
    # at least so many tokens stand in one of the two sets alone
    apart = F.col("owna") + F.col("ownb") + F.bit_count(F.col("bitsa").bitwiseXOR(F.col("bitsb")))
    close = apart <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + near
    cand = a.join(b, "h").where((F.col("a") < F.col("b")) & alike & close).select("a", "b").distinct()
    of = lambda c, x: s.select(F.col("id").alias(c), F.col(x).alias(f"{x}_{c}"))
    j = cand.join(of("a", "t"), "a").join(of("b", "t"), "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")).cast("bigint"))
    j = j.withColumn("jaccard", F.col("common") / (F.size("t_a") + F.size("t_b") - F.col("common"))).where(F.col("jaccard") >= threshold)
    j = j.select("a", "b", "common", F.round("jaccard", 6).alias("jaccard")).join(of("a", "ks"), "a").join(of("b", "ks"), "b")
    rows = lambda d: d.withColumn("x", F.explode("ks_a")).withColumn("y", F.explode("ks_b")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "jaccard", "x", "y")
    out = rows(j)
    if copies:
        equal = s.where("size(ks) > 1").select(F.col("ks").alias("ks_a"), F.col("ks").alias("ks_b"), F.size("t").cast("bigint").alias("common"), F.lit(1.0).alias("jaccard"))
        out = out.unionByName(rows(equal).where("x < y"))
    return out.drop("x", "y")
