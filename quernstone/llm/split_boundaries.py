"""Cutting oversized items at natural boundaries.

An item is an array of element texts and a limit of words. Recursive bisection: a stretch that is over its room is cut at
the strongest boundary near its midpoint (element end, sentence end, clause end, else between words), and both halves are
treated alike until they fit the limit less the overlap; each piece but the first then takes the last ``overlap`` words
before it.

Defined results: null elements are empty; empty items and items within the limit give no piece; a limit below 1 counts as 1,
an overlap of the limit or more as the limit less 1; a null limit sets none; repeated rows count once. Texts may be of any
length: the bisection is iterative.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize
from quernstone.plans.skew import salted_join
from quernstone.sources.tables import table

ELEMENT, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1
NAMES = {ELEMENT: "element", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", 0: "start"}
CLOSERS = "\"'’”)]»"
#: A boundary is near the midpoint if each half keeps at least this part of the words.
NEAR = 0.25


def untagged(element: Column) -> Column:
    """An element's text without its outer tag."""
    e = F.trim(element)
    return F.when(e.rlike(r"(?s)^<(\w+)>.*</\1>$"), F.regexp_replace(e, r"(?s)^<\w+>|</\w+>$", "")).otherwise(element)


def n_words(text: Column) -> Column:
    """Runs between white space of any kind."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x{FEFF}\x{1C}-\x{1F}]+"), lambda w: w != ""))


def strengths(elements: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The words, and for each the strength of the boundary after it."""
    words: list[str] = []
    after: list[int] = []
    for e in elements:
        own = (e or "").replace("﻿", " ").split()
        for w in own:
            core = w.rstrip(CLOSERS)
            after.append(SENTENCE if core[-1:] in ".!?…" and core else CLAUSE if core[-1:] in ",;:–—" and core else WORD)
        if own:
            after[-1] = ELEMENT
        words += own
    return words, np.asarray(after, dtype=np.int8)


def bisect(after: np.ndarray, room: int) -> list[tuple[int, int]]:
    """[start, end) of consecutive stretches of at most ``room`` words."""
    out, stack = [], [(0, len(after))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= room:
            out.append((lo, hi))
            continue
        mid = (lo + hi) / 2
        a, b = lo + max(1, int((hi - lo) * NEAR)), hi - max(1, int((hi - lo) * NEAR))
        best = _strongest(after, a, b, mid, CLAUSE) or _strongest(after, lo + 1, hi - 1, mid, CLAUSE) or int(mid)
        stack += [(best, hi), (lo, best)]
    return out


def _strongest(after: np.ndarray, a: int, b: int, mid: float, least: int) -> int | None:
    """The cut in [a, b] after the strongest boundary, nearest to ``mid``, the earlier of two; None below ``least``."""
    if b < a:
        return None
    own = after[a - 1 : b]
    top = own.max()
    if top < least:
        return None
    at = np.flatnonzero(own == top) + a
    return int(at[np.argmin(np.abs(at - mid))])


def spans(elements: list[str | None]) -> tuple[str, list[tuple[int, int]]]:
    """The elements' texts, a line break between them, and where each word stands."""
    text = "\n".join(e or "" for e in elements)
    return text, [m.span() for m in re.finditer(r"[^\s\ufeff]+", text)]


def pieces(elements: list[str | None], limit: int, overlap: int) -> list[dict]:
    """The pieces of one item; none if it is within the limit."""
    words, after = strengths(elements)
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if len(words) <= limit:
        return []
    whole, at = spans(elements)
    out = []
    for k, (lo, hi) in enumerate(bisect(after, limit - overlap)):
        start = max(0, lo - overlap)
        text = whole[at[start][0] : at[hi - 1][1]]
        out.append({"piece": k, "word_start": start, "word_end": hi, "n_overlap": lo - start, "cut_at": NAMES[int(after[lo - 1])] if lo else NAMES[0], "text": text})
    return out


def split_oversized(items: DataFrame, key: str = "id") -> DataFrame:
    """``items`` (key, elements array<string>, max_words, overlap_words) to (key, piece, word_start, word_end, n_overlap,
    cut_at, text), a row for each piece of an item over its limit."""
    kind = dict(items.dtypes)[key]
    schema = f"`{key}` {kind}, piece int, word_start int, word_end int, n_overlap int, cut_at string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, **p} for k, e, m, o in zip(b[key], b["elements"], b["max_words"], b["overlap_words"]) for p in pieces(list(e), int(m), int(o))]
            yield pd.DataFrame(rows, columns=[key, "piece", "word_start", "word_end", "n_overlap", "cut_at", "text"])

    bounded = items.where("elements IS NOT NULL AND max_words IS NOT NULL")
    return bounded.select(key, "elements", "max_words", F.coalesce("overlap_words", F.lit(0)).alias("overlap_words")).mapInPandas(run, schema)


def oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over the limit of their strategy: (chunk_id, elements, n_words, max_words, overlap_words).

    The words of a page are counted once, as running sums; a chunk takes the difference. Texts are joined only to the chunks
    over the limit.
    """
    limits = table(spark, sf_dir, "cut_limits").select("strategy", "max_words", "overlap_words").where("strategy IS NOT NULL").dropDuplicates(["strategy"])
    c = table(spark, sf_dir, "chunks").select("chunk_id", "doc", "el_start", "el_end", "strategy").where("chunk_id IS NOT NULL").distinct()
    c = c.join(limits, "strategy")  # one row for each strategy
    texts = (
        table(spark, sf_dir, "guide_docs").where("doc IS NOT NULL AND elements IS NOT NULL")
        .groupBy("doc").agg(F.max_by("elements", F.struct(F.coalesce("fetched_at", F.lit(0).cast("timestamp").cast("timestamp_ntz")), F.size("elements"))).alias("elements"))
        .select("doc", F.transform("elements", lambda e: F.coalesce(untagged(e), F.lit(""))).alias("texts"))
    )
    texts = materialize(texts.withColumn("n", F.transform("texts", n_words)), "pages")  # the two joins read a column each
    size = lambda x: F.greatest(F.lit(0), F.least("el_end", F.size(x)) - F.greatest("el_start", F.lit(0)))
    part = lambda x: F.slice(x, F.greatest("el_start", F.lit(0)) + 1, size(x))
    total = F.aggregate(part("n"), F.lit(0), lambda s, v: s + v)
    over = salted_join(c, texts.select("doc", "n"), "doc").withColumn("n_words", total).where("n_words > max_words").drop("n")
    return salted_join(over, texts.select("doc", "texts"), "doc").select("chunk_id", part("texts").alias("elements"), "n_words", "max_words", "overlap_words")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk over its limit."""
    return split_oversized(oversized_chunks(spark, sf_dir), "chunk_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id of the chunks that the operator cut."""
    return split_oversized(oversized_chunks(spark, sf_dir), "chunk_id").where("piece = 0").select("chunk_id").distinct()


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chunk cut: its words, how many of them the pieces hold in order without a gap, and whether all pieces keep the limit and
    neighbours share what they should."""
    over = materialize(oversized_chunks(spark, sf_dir).dropDuplicates(["chunk_id"]), "oversized")
    p = split_oversized(over, "chunk_id").join(over.select("chunk_id", "n_words", "max_words", "overlap_words"), "chunk_id")
    w = Window.partitionBy("chunk_id").orderBy("piece")  # the pieces of one chunk
    before = F.lag("word_end").over(w)
    p = p.withColumn("own", F.col("word_end") - F.col("word_start") - F.col("n_overlap")).withColumn("joined", F.coalesce(F.col("word_start") + F.col("n_overlap") == before, F.col("word_start") == 0))
    held = n_words(F.col("text")) == F.col("word_end") - F.col("word_start")
    kept = F.bool_and((F.col("word_end") - F.col("word_start") <= F.col("max_words")) & held)
    shared = F.bool_and(F.col("joined") & ((F.col("piece") == 0) | (F.col("n_overlap") == F.least(F.col("overlap_words"), F.col("word_start") + F.col("n_overlap")))))
    return p.groupBy("chunk_id").agg(F.max("n_words").cast("bigint").alias("n_words"), F.sum("own").cast("bigint").alias("n_held"), kept.alias("within_limit"), shared.alias("overlaps_kept"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}
P4 = r"""
WITH d AS (SELECT doc, arg_max(elements, fetched_at) AS elements FROM guide_docs GROUP BY doc),
w AS (SELECT doc, list_transform(elements, lambda e: len(list_filter(string_split_regex(regexp_replace(regexp_replace(trim(e), '^<\w+>', ''), '</\w+>$', ''), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{0085}]+'), lambda x: x <> ''))) AS n FROM d),
o AS (SELECT DISTINCT chunk_id, coalesce(list_sum(list_slice(n, el_start + 1, el_end)), 0)::BIGINT AS n_words FROM chunks JOIN cut_limits USING (strategy) JOIN w USING (doc) WHERE coalesce(list_sum(list_slice(n, el_start + 1, el_end)), 0) > max_words)
"""
ORACLES = {"p4_found": P4 + "SELECT chunk_id FROM o", "p4_cover": P4 + "SELECT chunk_id, n_words, n_words AS n_held, true AS within_limit, true AS overlaps_kept FROM o"}
