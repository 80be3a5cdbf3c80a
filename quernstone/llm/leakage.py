"""Evaluation texts leaking into training text, by latent semantic retrieval.

Passages are windows of two neighbouring blocks of ``BLOCK`` words. Words are hashed to ``TERMS`` terms; document frequencies
are counted over all documents. The right singular space of the TF-IDF matrix of passages comes from a distributed randomised
SVD: each task multiplies its own passages by the current basis and back, the products are summed by blocks of terms, and only
the sum (TERMS x RANK numbers, whatever the corpus) reaches the driver, which orthonormalises it. The space is an index: it is
fitted on the passages of about ``fit_documents`` documents chosen by hash, and every passage of every document is projected into
it. A passage's vector is the sum of its words' rows, so projecting costs a row lookup for each word.

All evaluation items, in blocks, are compared with all passages; pairs of a document and an item with a cosine of ``COSINE`` in
some window are candidates. Candidates without a run of common word
pairs over ``HELD`` of the item, from which the check starts, are left out; the rest are checked by the longest common
subsequence of the stretch they hold: at least half of the item's words, in order and in one stretch.

Defined results: null and empty texts hold nothing and are held nowhere; an item shorter than a window is one window; repeated
rows count once; empty tables give empty results; whole texts are read, of any length.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize
from quernstone.sources.tables import table

BLOCK = 16
TERMS = 1 << 14
RANK = 96
PASSES = 2
COSINE = 0.6
#: Least part of the item's words in the stretch, least part of the stretch that is common, most words between matches.
HELD, COMMON, GAP = 0.49, 0.72, 8
#: Items compared at once; more are compared in further passes over the documents.
ITEMS = 20_000
#: Common word pairs looked at in one go, about.
HITS = 1_000_000
#: Bits of the table by which word pairs of no item are told first.
SIEVE = 22
#: Parts into which a sum over terms is cut.
PARTS = 16

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Terms(dict):
    """Word to term, kept as words come."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        term = self[word] = zlib.crc32(word.encode()) % TERMS
        return term


def term_ids(own: list[str], known: Terms) -> np.ndarray:
    return np.array(list(map(known.__getitem__, own)), dtype=np.int32)


def blocks(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms in a row, the start of each block among them, and the document of each block."""
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(docs)), per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.concatenate(docs) if len(docs) else np.zeros(0, np.int32), np.repeat(starts, per) + within * BLOCK, owner


def passages(docs: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length of all windows, and the document of each. ``docs`` are not empty."""
    terms, at, owner = blocks(docs)
    sums = np.add.reduceat(rows[terms], at, axis=0)
    two = np.flatnonzero(owner[1:] == owner[:-1])
    alone = np.setdiff1d(np.arange(len(owner)), np.concatenate([two, two + 1]))  # texts of one block
    v = np.concatenate([sums[two] + sums[two + 1], sums[alone]])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.maximum(norm, 1e-9), np.concatenate([owner[two], owner[alone]])


def _summed(parts: DataFrame, dtype: str) -> np.ndarray | None:
    """The sum of arrays emitted as (part, salt, sums); one array of fixed size reaches the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(bytes(x), dtype=dtype) for x in pdf["sums"])
        return pd.DataFrame({"part": pdf["part"][:1], "salt": pdf["salt"][:1], "sums": [total.tobytes()]})

    schema = "part int, salt int, sums binary"
    once = parts.groupBy("part", "salt").applyInPandas(add, schema).withColumn("salt", F.lit(0))
    rows = sorted(once.groupBy("part").applyInPandas(add, schema).collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(bytes(r["sums"]), dtype=dtype) for r in rows]) if rows else None


def _emit(a: np.ndarray, salt: int) -> pd.DataFrame:
    cut = np.array_split(a, PARTS)
    return pd.DataFrame({"part": range(PARTS), "salt": salt, "sums": [x.tobytes() for x in cut]}).astype({"part": "int32", "salt": "int32"})


def inverse_document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """idf of each term over all documents, and the number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, known = np.zeros(TERMS + PARTS, dtype=np.int64), Terms()
        for b in batches:
            seen: Counter = Counter()
            for t in b["text"]:
                own = set(words(t))
                seen.update(own)
                df[-1] += bool(own)
            if seen:
                np.add.at(df, term_ids(list(seen), known), np.fromiter(seen.values(), dtype=np.int64))
        yield _emit(df, TaskContext.get().partitionId() % 64)

    total = _summed(documents.select("text").mapInPandas(run, "part int, salt int, sums binary"), "int64")
    n = int(total[-1]) if total is not None else 0
    return np.log((n + 1) / ((total[:TERMS] if total is not None else np.zeros(TERMS)) + 1)) + 1e-3, n


def latent_rows(documents: DataFrame, idf: np.ndarray, n: int, fit_documents: int = 4000) -> np.ndarray:
    """A row for each term: idf times its coordinates in the latent space (TERMS x RANK)."""
    spark = documents.sparkSession
    rate = min(1.0, fit_documents / max(n, 1))
    sample = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(rate * 1_000_000)).select("text")
    sample = materialize(sample.coalesce(8), "fit")  # of bounded size
    basis = np.random.default_rng(0).standard_normal((TERMS, RANK)).astype(np.float32)
    weight = idf.astype(np.float32)
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast((basis, weight))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, w = shared.value
            z, known, seen = np.zeros((TERMS, RANK), np.float32), Terms(), 0
            for b in batches:
                docs = [d for d in (term_ids(words(t), known) for t in b["text"]) if len(d)]
                for i in range(0, len(docs), 256):
                    terms, at, _ = blocks(docs[i : i + 256])
                    at = at[::2]  # passages of two blocks that do not overlap
                    length = np.add.reduceat(w[terms] ** 2, at)
                    y = np.add.reduceat(q[terms] * w[terms][:, None], at, axis=0) / np.maximum(length, 1e-9)[:, None]
                    row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(terms))))
                    order = np.argsort(terms, kind="stable")
                    own, first = np.unique(terms[order], return_index=True)
                    z[own] += np.add.reduceat(y[row[order]], first, axis=0) * w[own][:, None]
                    seen += len(docs)
            if seen:
                yield _emit(z.ravel(), TaskContext.get().partitionId() % 8)

        z = _summed(sample.mapInPandas(run, "part int, salt int, sums binary"), "float32")
        if z is None:
            break
        basis = np.linalg.qr(z.reshape(TERMS, RANK).astype(np.float64))[0].astype(np.float32)
    return basis * weight[:, None]


def held_stretch(item: list[str], doc: list[str], where: dict[tuple[str, str], list[int]]) -> float:
    """Part of the item's words that lie in one stretch of the document, in order; 0 if too little of it is common."""
    n = len(item)
    if n < 3:
        return float(any(doc[j : j + n] == item for j in range(len(doc) - n + 1))) if n else 0.0
    lanes = defaultdict(list)
    for i in range(n - 1):
        for j in where.get((item[i], item[i + 1]), ()):
            lanes[(j - i) // BLOCK].append((i, j))
    best = 0.0
    for lane in lanes.keys() | {k + 1 for k in lanes}:
        own = lanes.get(lane, []) + lanes.get(lane - 1, [])
        if len(own) < least_hits(n):
            continue
        own.sort()
        runs, start = [], 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k][0] - own[k - 1][0] > GAP:
                runs.append(own[start:k])
                start = k
        for run in runs:
            lo, hi = run[0][0], run[-1][0] + 2
            if (hi - lo) / n <= best or (hi - lo) / n < HELD:
                continue
            js = [j for _, j in run]
            if common_subsequence(item[lo:hi], doc[min(js) : max(js) + 2]) >= COMMON * (hi - lo):
                best = (hi - lo) / n
    return best


def least_hits(n: int) -> float:
    """Fewest word pairs in common of a stretch of ``HELD`` of ``n`` words: h pairs, at most ``GAP`` apart, reach over (h - 1) GAP + 2 words."""
    return max(1.0, (HELD * n - 2) / GAP + 1 - 1e-9)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits for each word of ``b``."""
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        at[w] |= 1 << i
    row = 0
    for w in b:
        x = row | at.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def pair_codes(terms: np.ndarray) -> np.ndarray:
    """A number for each pair of neighbouring terms; equal words are equal terms, so no common pair of words is lost."""
    return terms[:-1].astype(np.int64) * TERMS + terms[1:]


def sieved(codes: np.ndarray) -> np.ndarray:
    return (codes * 0x9E3779B1 >> 7) & ((1 << SIEVE) - 1)


class Runs:
    """Tells which documents can hold which items: those with a run of common word pairs from which ``held_stretch`` starts."""

    def __init__(self, items: list[np.ndarray]):
        grams = [pair_codes(w) for w in items]
        self.length = np.array([len(w) for w in items], dtype=np.int64)
        code = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.codes, gram = np.unique(code, return_inverse=True)
        self.seen = np.zeros(1 << SIEVE, dtype=bool)
        self.seen[sieved(self.codes)] = True
        sizes = np.array([len(own) for own in grams], dtype=np.int64)
        order = np.argsort(gram, kind="stable")
        self.item = np.repeat(np.arange(len(items)), sizes)[order]
        self.at = (np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        self.first = np.searchsorted(gram[order], np.arange(len(self.codes) + 1))

    def possible(self, docs: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        """Of ``pairs`` (document x items + item), those with a run that reaches over ``HELD`` of the item; items under three words stay."""
        n = len(self.length)
        wanted = np.zeros(len(docs) * n, dtype=bool)
        wanted[pairs] = True
        kept = [pairs[self.length[pairs % n] < 3]]
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        code = pair_codes(np.concatenate(docs))
        near = np.flatnonzero(self.seen[sieved(code)])
        gram = np.minimum(np.searchsorted(self.codes, code[near]), len(self.codes) - 1)
        doc = np.searchsorted(start, near, side="right") - 1
        here = (self.codes[gram] == code[near]) & (near + 1 < start[doc] + sizes[doc])  # no pair of two documents
        gram, doc, place = gram[here], doc[here], (near - start[doc])[here]
        if not len(doc):
            return kept[0]
        times = self.first[gram + 1] - self.first[gram]
        longest = int(self.length.max())
        low = longest // BLOCK + 1
        lanes, stride = int(place.max()) // BLOCK + low + 3, longest + GAP + 2
        part = (np.cumsum(times) - times) // HITS
        for c in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(part[np.searchsorted(doc, doc)])) + 1):  # whole documents
            t = times[c]
            at = np.repeat(self.first[gram[c]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            pair, i, j = np.repeat(doc[c] * n, t) + self.item[at], self.at[at], np.repeat(place[c], t)
            use = np.flatnonzero(wanted[pair])
            if not len(use):
                continue
            pair, i, j = pair[use], i[use], j[use]
            code = (pair * lanes + (j - i) // BLOCK + low) * stride + i
            code = np.concatenate([code, code + stride])  # a lane holds the hits of its own and of the one before
            code.sort()
            cut = np.flatnonzero(np.diff(code) > GAP)
            start, end = code[np.append(0, cut + 1)], code[np.append(cut, len(code) - 1)]
            pair = start // stride // lanes
            kept.append(pair[(end - start + 2) / self.length[pair % n] >= HELD])
        return np.unique(np.concatenate(kept))


def find_leaks(documents: DataFrame, items: DataFrame, fit_documents: int = 4000) -> DataFrame:
    """``documents`` (doc_id, text) and ``items`` (item_id, text) to distinct (item_id, doc_id, held)."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    kinds = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    idf, n = inverse_document_frequencies(documents)
    rows = latent_rows(documents, idf, n, fit_documents)
    passes = max(1, -(-items.count() // ITEMS))
    out = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()  # about ITEMS of the stated query set
        found = _search(documents, [(r["item_id"], words(r["text"])) for r in block], rows, kinds)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("item_id", "doc_id").agg(F.max("held").alias("held"))


def _search(documents: DataFrame, items: list[tuple], rows: np.ndarray, kinds: tuple[str, str]) -> DataFrame:
    items = [(i, w) for i, w in items if w]
    vectors, owner = passages([term_ids(w, Terms()) for _, w in items], rows) if items else (np.zeros((0, RANK), np.float32), np.zeros(0, int))
    shared = documents.sparkSession.sparkContext.broadcast((rows, vectors.astype(np.float32), owner, items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, m, of, its = shared.value
        known = Terms()
        runs = Runs([term_ids(w, known) for _, w in its])
        for b in batches:
            own = [(d, w) for d, w in zip(b["doc_id"], map(words, b["text"])) if w]
            out = []
            for i in range(0, len(own) if its else 0, 128):
                part = own[i : i + 128]
                ids = [term_ids(w, known) for _, w in part]
                v, doc = passages(ids, basis)
                near_pairs = []
                for c in range(0, len(m), 4096):
                    near = v @ m[c : c + 4096].T
                    x, y = np.divmod(np.flatnonzero(near.ravel() >= COSINE), near.shape[1])
                    near_pairs.append(doc[x].astype(np.int64) * len(its) + of[c + y])
                by = defaultdict(list)
                for p in runs.possible(ids, np.unique(np.concatenate(near_pairs))).tolist():
                    by[p // len(its)].append(p % len(its))
                for d, cand in by.items():
                    text = part[d][1]
                    where = defaultdict(list)
                    for j, g in enumerate(zip(text, text[1:])):
                        where[g].append(j)
                    for k in cand:
                        h = held_stretch(its[k][1], text, where)
                        if h >= HELD:
                            out.append((its[k][0], part[d][0], h))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "held"])

    return documents.mapInPandas(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, held double")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with each document that holds it, and the part held."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("item_id", "doc_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "kind", "split", "domain").distinct()
    n = p6_leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("held").alias("most_held"))
    return items.join(n, "item_id")


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks, "p6_items": p6_items}
ORACLES: dict[str, str] = {}
