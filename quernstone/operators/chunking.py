"""Greedy packing of elements or sentences into chunks: a fold over one row's array, so no shuffle and no skew by key."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

TOP = ("h1", "h2")
HEADS = ("h1", "h2", "h3", "h4")


def pack_elements(words: list[int], tags: list[str], budget: int, section: bool) -> list[tuple[int, int]]:
    """[start, end) ranges: elements are added while they fit; an element over the budget stands alone. With ``section`` a
    top heading opens a chunk, and headings at a chunk's end go with what follows, even past the budget."""
    before = [0, *accumulate(words)]
    cuts = [0]
    for i in range(1, len(words)):
        start = cuts[-1]
        if i > start and (before[i + 1] - before[start] > budget or section and tags[i] in TOP):
            heads = next((k for k in range(i - 1 - start) if tags[i - 1 - k] not in HEADS), i - 1 - start) if section else 0
            cuts.append(i - heads)
    return list(zip(cuts, [*cuts[1:], len(words)])) if words else []


def pack_sentences(words: list[int], target: int, least: int) -> list[tuple[int, int]]:
    """[start, end) ranges of sentences; a last group of fewer than ``least`` words joins the one before it."""
    out, start, total = [], 0, 0
    for i, w in enumerate(words):
        if i > start and total + w > target:
            out.append((start, i))
            start, total = i, 0
        total += w
    if words:
        out.append((start, len(words)))
    if len(out) > 1 and sum(words[out[-1][0] :]) < least:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return out


def packed(rows: DataFrame, key: str, budget: int, section: bool = False) -> DataFrame:
    """``rows`` (key, words array<bigint>, tags array<string>) to (key, idx, el_start, el_end, n_words)."""
    schema = f"{key} {dict(rows.dtypes)[key]}, idx bigint, el_start bigint, el_end bigint, n_words bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, s, e, int(sum(w[s:e]))) for k, w, t in zip(b[key], b["words"], b["tags"]) for i, (s, e) in enumerate(pack_elements(list(w), list(t), budget, section))]
            yield pd.DataFrame(out, columns=[key, "idx", "el_start", "el_end", "n_words"])

    return rows.select(key, "words", "tags").mapInPandas(run, schema)


def packed_sentences(rows: DataFrame, key: str, target: int = 140, least: int = 50) -> DataFrame:
    """``rows`` (key, words array<bigint>) to (key, idx, s_start, s_end, n_words)."""
    schema = f"{key} {dict(rows.dtypes)[key]}, idx bigint, s_start bigint, s_end bigint, n_words bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, s, e, int(sum(w[s:e]))) for k, w in zip(b[key], b["words"]) for i, (s, e) in enumerate(pack_sentences(list(w), target, least))]
            yield pd.DataFrame(out, columns=[key, "idx", "s_start", "s_end", "n_words"])

    return rows.select(key, "words").mapInPandas(run, schema)
