"""Where texts end and where the same words go on: a self-join by prefix that tells which texts were cut.

The words before an end are looked up in all texts, longest first: the text from its start, then its last ``LENGTHS`` words. Each is
a strict prefix of every copy that goes on behind it. The first that was seen often enough tells: if it nearly always goes on, and
hardly ever ends, the text was cut there. A last word that only begins another word is found by the same join on single words.

Words are joined by hashes of 64 bits. Texts are counted once each before their words are hashed, and of the hashes only those
some end may ask for are counted (a bitmap of fixed size tells; what it lets through too much finds no partner in the join).
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.materialize import discard, materialize

#: Numbers of last words that are looked up, besides the text from its start.
LENGTHS = (8, 6, 5, 4, 3, 2, 1)
#: At most this often do words end that nearly always go on, for each time they do; behind a
#: name or figure, which may have more or fewer words.
ENDED, NAMES_ENDED = 0.1, 0.05
#: Bits of the map of the hashes asked for (2 ** 18 bytes).
BITS = 1 << 21

MASKS = frozenset("X9")

_TOKEN = re.compile(r"\d[\d,.]*\d|\d|[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_+")
_FACTOR = 0x9E3779B97F4A7C15


def masked_tokens(text: str) -> list[str]:
    """Words and marks; words that begin with a capital are X, figures 9, so that a text has others like it."""
    return ["9" if w[0].isdigit() else "X" if w[0].isupper() else w for w in _TOKEN.findall(text)]


class Numbers(dict):
    """Word to a number of 64 bits, kept as words come."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        b = word.encode()
        n = self[word] = ((zlib.crc32(b) << 32) | zlib.crc32(b, 0x5BD1E995)) * _FACTOR % (1 << 64)
        return n


def context_hashes(texts: list[list[str]], known: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, valid, at): for each word of all texts in a row the hashes of what ends there, longest first, whether the text
    reaches so far back, and the place of the word in its text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(sizes.sum())
    word = np.fromiter((known[w] for t in texts for w in t), dtype=np.uint64, count=n)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(int(sizes.max()) if n else 0, max(LENGTHS)), np.uint64(_FACTOR | 1))]), dtype=np.uint64)
        run = np.cumsum(word * powers[at], dtype=np.uint64)
        before = np.repeat(np.concatenate([[np.uint64(0)], run])[np.cumsum(sizes) - sizes], sizes) if n else run
        out, valid = [_mixed(run - before, 0)], [np.ones(n, dtype=bool)]
        total, by_length = np.zeros(n, np.uint64), {}
        for k in range(1, max(LENGTHS) + 1):
            total = total + np.concatenate([np.zeros(min(k - 1, n), np.uint64), word[: max(n - k + 1, 0)]]) * powers[k - 1]
            by_length[k] = total
        for k in LENGTHS:
            out.append(_mixed(by_length[k], k))
            valid.append(at >= k - 1)
    return np.stack(out, axis=1), np.stack(valid, axis=1), at


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(k * 0xD6E8FEB8 + 1)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _keys(name_words: int):
    """Of each distinct end: its keys, longest first. Behind a name or figure only words with ``name_words`` others count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, reach = Numbers(), np.array([1 << 40, *LENGTHS])
        for b in batches:
            texts = [v.split(" ") for v in b["v"]]
            h, valid, at = context_hashes(texts, known)
            last = np.cumsum([len(t) for t in texts]) - 1
            keys = []
            for t, i in zip(texts, last):
                ok = valid[i]
                if name_words and t[-1] in MASKS:
                    others = np.cumsum([w not in MASKS for w in reversed(t)])
                    ok = ok & (others[np.minimum(reach, len(t)) - 1] >= name_words)
                keys.append(h[i][ok])
            yield pd.DataFrame({"v": b["v"], "named": [t[-1] in MASKS for t in texts], "keys": keys})

    return run


def open_ends(values: DataFrame, ends: DataFrame, seen: int, name_words: int = 0) -> DataFrame:
    """``values`` (v, n): texts as masked words with a blank between, and how often each stands; ``ends`` (v): those asked about, all
    of them among the values. To (v): those that were cut. Words are evidence once they stand ``seen`` times elsewhere."""
    spark = values.sparkSession
    tails = materialize(ends.where("v <> ''").select("v").distinct().mapInPandas(_keys(name_words), "v string, named boolean, keys array<bigint>"), "ends")
    bits = tails.select(F.explode("keys").alias("key")).select((F.pmod("key", F.lit(BITS)) + 1).alias("b"))
    maps = bits.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    asked = np.zeros((BITS // 32768 + 2, 4096), np.uint8)
    for r in maps.collect():  # at most BITS / 32768 rows of 4 kB, numbered from 1
        asked[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    flat = spark.sparkContext.broadcast(asked[1:].ravel().tobytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = Numbers(), np.frombuffer(flat.value, np.uint8)
        for b in batches:
            texts = [v.split(" ") for v in b["v"]]
            h, valid, at = context_hashes(texts, known)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            times = np.repeat(b["n"].to_numpy(np.int64), sizes)
            ending = np.zeros(len(at), dtype=bool)
            ending[np.cumsum(sizes) - 1] = True
            place = np.mod(h, BITS)
            valid &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            row = np.nonzero(valid)[0]
            key, inverse = np.unique(h[valid], return_inverse=True)
            on, end = (np.bincount(inverse, np.where(ending[row] == e, times[row], 0), len(key)).astype(np.int64) for e in (False, True))
            yield pd.DataFrame({"key": key, "goes_on": on, "ends": end})

    counts = values.where("v <> ''").select("v", "n").mapInPandas(count, "key bigint, goes_on bigint, ends bigint").groupBy("key").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    known = counts.where(F.col("goes_on") + F.col("ends") > seen)
    found = tails.select("v", "named", F.posexplode("keys").alias("rank", "key")).join(known, "key")
    first = found.groupBy("v", "named").agg(F.min_by(F.struct("goes_on", "ends"), "rank").alias("s"))
    share = F.when(F.col("named") & F.lit(name_words > 0), NAMES_ENDED).otherwise(ENDED)
    out = materialize(first.where(F.col("s.ends") - 1 <= share * F.col("s.goes_on")).where("s.goes_on > 0").select("v"), "open-ends")
    discard(tails)
    return out


def beginnings(word: Column, least: int = 1) -> Column:
    """All strict prefixes of a word from ``least`` letters on."""
    n = F.length(word)
    return F.when(n > least, F.transform(F.sequence(F.lit(least), F.greatest(n - 1, F.lit(least))), lambda i: F.substring(word, F.lit(1), i)))
