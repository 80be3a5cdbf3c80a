"""Blocked retrieval against brute force: ties, empty texts, several blocks."""
import math
import random
import re
from collections import Counter

import pytest

from quernstone.operators import retrieval as R

DOC = "doc_id string, text string"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["the", "fee", "of", "rent", "grant", "bond", "visa", "tax", "day", "week", "3", "40"]
    return [(f"d{i:03}", " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(n)] + [("same1", "rent bond visa"), ("same2", "rent bond visa"), ("none", None), ("blank", "")]


def asked(seed=2, n=25):
    rng = random.Random(seed)
    return [(f"q{i:02}", " ".join(rng.choices(["fee", "rent", "grant", "bond", "visa", "tax", "unseen", "the"], k=rng.randint(1, 5)))) for i in range(n)] + [("empty", ""), ("nil", None)]


def toks(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def brute(queries, docs, score, k):
    out = {}
    for q, text in queries:
        rows = sorted(((-round(score(toks(text), toks(t)), 9), d) for d, t in docs if t is not None and set(toks(text)) & set(toks(t))))[:k]
        for rank, (s, d) in enumerate(rows, 1):
            out[q, rank] = (d, -s)
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_rankings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "QUERIES", block)
    docs, queries = corpus(), asked()
    d, q = spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(queries, "qid string, text string")
    own = [toks(t) for _, t in docs if t is not None]
    n, avg = len(own), sum(map(len, own)) / len(own)
    df = Counter(w for t in own for w in set(t))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}

    def bm25(a, b):
        tf = Counter(b)
        return sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in a if tf[w])

    for operator, score in ((R.bm25, bm25), (R.token_overlap, lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)))):
        got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in operator(q, d, 6).collect()}
        expected = brute(queries, docs, score, 6)
        assert got.keys() == expected.keys()
        assert all(got[x][0] == expected[x][0] and got[x][1] == pytest.approx(expected[x][1], abs=1e-8) for x in got)
        assert operator(q.limit(0), d, 6).count() == 0 and operator(q, d.limit(0), 6).count() == 0


@pytest.mark.parametrize("block", [1000, 3])
def test_neighbours_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "QUERIES", block)
    rng = random.Random(4)
    vectors = [(i, [rng.randint(-2, 2) / 1.0 for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4)]
    d = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(4)
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in R.knn(d.where("vec_id % 7 = 0"), d, 4).collect()}

    def cosine(a, b):
        m = math.dist(a, [0] * 4) * math.dist(b, [0] * 4)
        return round(sum(x * y for x, y in zip(a, b)) / m, 9) if m else 0.0

    for q, v in vectors:
        if q % 7 == 0 and v is not None:
            best = sorted((-cosine(v, w), i) for i, w in vectors if i != q and w is not None)[:4]
            assert [got[q, r] for r in range(1, 5)] == [i for _, i in best]


def test_texts_that_hold_items(spark):
    docs = [("a", "we pay rent and tax"), ("b", "rent and"), ("c", None), ("d", "tax"), ("d", "tax")]
    items = [("x", "rent and"), ("y", "tax"), ("z", "rent and"), ("e", ""), ("n", None)]
    got = sorted((r["qid"], r["doc_id"]) for r in R.holding(spark.createDataFrame(items, "qid string, text string"), spark.createDataFrame(docs, DOC)).collect())
    assert got == [("x", "a"), ("x", "b"), ("y", "a"), ("y", "d"), ("z", "a"), ("z", "b")]
