"""Lexical and dense retrieval, rank fusion and ranking metrics.

Queries are a stated set. In blocks of ``QUERIES`` they become sparse weights that every task holds; each document is read once for a
block and scored against all of it, and a task gives out the k best of each query: what is moved is k rows for each query and task,
never a row for each query and document.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import tokens
from quernstone.plans.materialize import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Queries scored at once, and documents.
QUERIES, DOCUMENTS = 1000, 2048
#: A term of more than this part of the queries is multiplied as a dense row, the others one by one.
COMMON = 0.1


class Best:
    """The k best of each query so far, of equal scores the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.n = k, n_queries
        self.col, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (documents x queries), -inf where a document is no answer."""
        if len(ids) > self.k:
            least = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            row, col = np.nonzero((scores >= least) & np.isfinite(scores))
        else:
            row, col = np.nonzero(np.isfinite(scores))
        col, score, own = np.concatenate([self.col, col]), np.concatenate([self.score, scores[row, col]]), ids[row]
        own = own if self.ids is None else np.concatenate([self.ids, own])
        order = np.lexsort((own, -score, col))
        col, score, own = col[order], score[order], own[order]
        place = np.arange(len(col)) - np.searchsorted(col, col)
        keep = place < self.k
        self.col, self.score, self.ids = col[keep], score[keep], own[keep]


class Block:
    """A block of queries as weights of terms."""

    def __init__(self, rows: list[tuple]):
        """``rows`` (query, term, weight)."""
        self.queries = sorted({r[0] for r in rows})
        at = {q: i for i, q in enumerate(self.queries)}
        names = sorted({r[1] for r in rows})
        self.terms = {t: i for i, t in enumerate(names)}
        term = np.array([self.terms[r[1]] for r in rows], dtype=np.int64)
        col, weight = np.array([at[r[0]] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.float64)
        order = np.argsort(term, kind="stable")
        self.col, self.weight = col[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(names) + 1))
        common = np.flatnonzero(np.diff(self.first) > COMMON * len(self.queries))
        self.dense_at = np.full(len(names), -1)
        self.dense_at[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.queries)))
        self.has = np.zeros((len(common), len(self.queries)))
        for i, t in enumerate(common):
            own = slice(self.first[t], self.first[t + 1])
            self.dense[i, self.col[own]] = self.weight[own]
            self.has[i, self.col[own]] = 1

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of value x weight, and numbers of shared terms, of each document and query."""
        n = len(self.queries)
        dense = self.dense_at[term] >= 0
        a, m = np.zeros((n_docs, len(self.dense))), np.zeros((n_docs, len(self.dense)))
        a[doc[dense], self.dense_at[term[dense]]] = value[dense]
        m[doc[dense], self.dense_at[term[dense]]] = 1
        d, t, v = doc[~dense], term[~dense], value[~dense]
        times = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cell = np.repeat(d * n, times) + self.col[at]
        total = np.bincount(cell, np.repeat(v, times) * self.weight[at], n_docs * n).reshape(n_docs, n) + a @ self.dense
        return total, np.bincount(cell, minlength=n_docs * n).reshape(n_docs, n) + m @ self.has


def _rank_block(d: DataFrame, block: Block, k: int, qid_type: str, score: Callable) -> DataFrame:
    """``d`` (doc_id, t) to the k best of each task: ``score(block, n_docs, doc, term, count, lengths, distinct)``, -inf for no answer."""
    shared = d.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        best, n = Best(len(own.queries), k), max(len(own.terms), 1)
        for b in batches:
            for i in range(0, len(b), DOCUMENTS):
                part = b.iloc[i : i + DOCUMENTS]
                lists = list(part["t"])
                lengths, distinct = np.array([len(t) for t in lists]), np.array([len(set(t)) for t in lists])
                ids = np.array([own.terms.get(w, -1) for t in lists for w in t], dtype=np.int64)
                doc = np.repeat(np.arange(len(lists)), lengths)
                code, count = np.unique((doc * n + ids)[ids >= 0], return_counts=True)
                names = part["doc_id"].to_numpy()
                best.add(score(own, len(lists), code // n, code % n, count, lengths, distinct), names if names.dtype != object else names.astype(str))
        if len(best.col):
            yield pd.DataFrame({"qid": [own.queries[c] for c in best.col], "doc_id": best.ids.tolist(), "score": best.score})

    return d.mapInPandas(run, f"qid {qid_type}, doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def _ranked(q: DataFrame, d: DataFrame, k: int, weigh: Callable[[DataFrame], list[tuple]], score: Callable) -> DataFrame:
    """``q`` (qid, t) in blocks over ``d`` (doc_id, t)."""
    qid_type = q.schema["qid"].dataType.simpleString()
    blocks = max(1, -(-q.count() // QUERIES))
    out = None
    for i in range(blocks):
        rows = weigh(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i))  # the terms of one block of queries
        best = _rank_block(d, Block(rows), k, qid_type, score)
        out = best if out is None else out.unionByName(best)
    return top_k(out, "qid", [F.desc("score"), F.asc("doc_id")], k)


def _tokenised(df: DataFrame, key: str) -> DataFrame:
    return df.where(f"{key} IS NOT NULL AND text IS NOT NULL").select(key, tokens(F.col("text")).alias("t"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """``queries`` (qid, text) over ``docs`` (doc_id, text) to (qid, doc_id, score, rank): the k best that share a term.

    A negative idf counts as EPSILON times the mean idf of the whole vocabulary. Scores are rounded to nine places before they are
    ranked, ties go to the smaller doc_id.
    """
    d = _tokenised(docs, "doc_id")
    size = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = d.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))  # size: one row
    idf = materialize(idf, "idf")
    whole = idf.agg(F.avg("idf").alias("mean"), F.max("avgdl").alias("avgdl")).first()
    mean, avgdl = whole["mean"], whole["avgdl"] or 1.0

    def weigh(block: DataFrame) -> list[tuple]:
        asked = block.select("qid", F.explode("t").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
        rows = asked.join(idf, "term").select("qid", "term", "qtf", "idf").collect()
        return [(r["qid"], r["term"], r["qtf"] * (EPSILON * mean if r["idf"] < 0 else r["idf"]) * (K1 + 1)) for r in rows]

    def score(block, n, doc, term, count, lengths, distinct):
        total, shared = block.scores(n, doc, term, count / (count + K1 * (1 - B + B * lengths[doc] / avgdl)))
        return np.where(shared > 0, np.round(total, 9), -np.inf)

    return _ranked(_tokenised(queries, "qid"), d, k, weigh, score)


def token_overlap(queries: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """As ``bm25``, by the Jaccard of distinct tokens."""

    def weigh(block: DataFrame) -> list[tuple]:
        return [(r["qid"], w, 1.0) for r in block.collect() for w in set(r["t"])]

    def score(block, n, doc, term, count, lengths, distinct):
        common, _ = block.scores(n, doc, term, np.ones(len(doc)))
        sizes = np.bincount(block.col, minlength=len(block.queries))
        return np.where(common > 0, np.round(common / np.maximum(sizes[None, :] + distinct[:, None] - common, 1), 9), -np.inf)

    return _ranked(_tokenised(queries, "qid"), _tokenised(docs, "doc_id"), k, weigh, score)


def holding(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id): documents whose text holds an item's word for word. All items of a block are looked for in one pass over a text
    (Aho-Corasick). Empty items are held nowhere."""
    import ahocorasick

    q = items.where("qid IS NOT NULL AND text <> ''").select("qid", "text").distinct()
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    types = q.schema["qid"].dataType.simpleString(), d.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-q.count() // QUERIES))
    out = None
    for i in range(blocks):
        words: dict[str, list] = {}
        for r in q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect():
            words.setdefault(r["text"], []).append(r["qid"])
        shared = d.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            machine = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                machine.add_word(text, ids)
            machine.make_automaton()
            for b in batches:
                found = [(q, doc) for doc, text in zip(b["doc_id"], b["text"]) for q in {x for _, ids in machine.iter(text) for x in ids}] if shared.value else []
                yield pd.DataFrame(found, columns=["qid", "doc_id"])

        own = d.mapInPandas(run, f"qid {types[0]}, doc_id {types[1]}")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def top_k(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def knn(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine of a stated query set (vec_id, embedding) with all items but itself: (qid, vec_id, cosine, rank). Queries are
    multiplied in blocks, so what a task holds does not grow with them. A vector of length 0 has cosine 0."""
    q = queries.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = items.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    types = q.schema["qid"].dataType.simpleString(), d.schema["vec_id"].dataType.simpleString()
    blocks = max(1, -(-q.count() // QUERIES))
    out = None
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # about QUERIES vectors
        names, m = np.array([r["qid"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
        shared = d.sparkSession.sparkContext.broadcast((names, m, np.linalg.norm(m, axis=1) if len(rows) else np.zeros(0)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, vectors, lengths = shared.value
            best = Best(len(own), k)
            for b in batches:
                for j in range(0, len(b) if len(own) else 0, DOCUMENTS):
                    ids, v = b["vec_id"].to_numpy()[j : j + DOCUMENTS], np.stack(b["embedding"].to_numpy()[j : j + DOCUMENTS])
                    both = np.linalg.norm(v, axis=1)[:, None] * lengths[None, :]
                    cosine = np.round(np.divide(v @ vectors.T, both, out=np.zeros_like(both), where=both > 0), 9)
                    best.add(np.where(ids[:, None] == own[None, :], -np.inf, cosine), ids)
            if len(best.col):
                yield pd.DataFrame({"qid": own[best.col].tolist(), "vec_id": best.ids.tolist(), "cosine": best.score})

        found = d.mapInPandas(run, f"qid {types[0]}, vec_id {types[1]}, cosine double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, "qid", [F.desc("cosine"), F.asc("vec_id")], k)


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], k: int, key: str = "qid", item: str = "doc_id") -> DataFrame:
    """(key, item, score, rank and a column <name>_rank for each ranking): the sum of 1 / (60 + rank)."""
    every = None
    for name, r in rankings.items():
        r = r.select(key, item, F.col("rank").alias("r"), F.lit(name).alias("by"))
        every = r if every is None else every.unionByName(r)
    own = [F.max(F.when(F.col("by") == n, F.col("r"))).alias(f"{n}_rank") for n in rankings]
    fused = every.groupBy(key, item).agg(F.round(F.sum(1 / (RRF_K + F.col("r"))), 9).alias("score"), *own)
    return top_k(fused, key, [F.desc("score"), F.asc(item)], k)


def recall_at(ranking: DataFrame, gold: DataFrame, ks: list[int], key: str = "qid", item: str = "doc_id") -> DataFrame:
    """Macro recall and hit share at each k, and the mean reciprocal rank of the first hit; a query without a hit counts 0."""
    g = gold.select(key, item).distinct()
    found = g.join(ranking.select(key, item, "rank"), [key, item], "left")
    grid = g.sparkSession.createDataFrame([(k,) for k in ks], "k bigint")
    per = found.crossJoin(F.broadcast(grid)).groupBy(key, "k").agg(F.avg((F.coalesce("rank", F.lit(1 << 40)) <= F.col("k")).cast("double")).alias("recall"), F.min("rank").alias("first"))
    hit = F.col("first") <= F.col("k")
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("hit_share"), F.round(F.avg(F.when(hit, 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr"))
