"""Signatures and thresholds: hand-checked unification, groups, decisions; running sums with and without one key."""
import random

from pyspark.sql import functions as F

from quernstone.operators import metrics as M
from quernstone.operators import signatures as G

TREE = [("event", "cash", "transaction"), ("event", "atm cash", "cash"), ("event", "card", "transaction"), ("who", "student", "person"), ("who", "phd student", "student")]
RAW = [
    ("a", "event", " Cash "), ("b", "event", "ATM"), ("b", "who", "student"), ("c", "event", "card"), ("d", "event", "transaction"), ("d", "who", ""), ("e", "event", "barter"), ("f", "event", "Barter"),
    ("g", "event", "swap"), ("h", "event", "cash"), ("h", "who", "phd student"), ("i", "event", "atm cash"), ("i", "who", None),
]


def parts(spark):
    tree = spark.createDataFrame(TREE, "slot string, value string, parent string")
    alias = spark.createDataFrame([("event", "ATM", "atm cash")], "slot string, alias string, value string")
    sigs = G.signatures(spark.createDataFrame(RAW, "frame string, slot string, value string"), tree, {"event": "transaction", "who": "person"}, alias)
    return sigs, G.ancestors(tree)


def test_signatures_know_the_vocabulary(spark):
    sigs, above = parts(spark)
    got = {(r["frame"], r["slot"]): (r["typed"], r["untyped"]) for r in sigs.collect()}
    assert got == {
        ("a", "event"): ("cash", None), ("b", "event"): ("atm cash", None), ("b", "who"): ("student", None), ("c", "event"): ("card", None), ("e", "event"): (None, "barter"), ("f", "event"): (None, "barter"),
        ("g", "event"): (None, "swap"), ("h", "event"): ("cash", None), ("h", "who"): ("phd student", None), ("i", "event"): ("atm cash", None),
    }
    assert ("event", "atm cash", "transaction") in {tuple(r) for r in above.select("slot", "value", "ancestor").collect()}


def test_unification(spark):
    sigs, above = parts(spark)
    expected = {
        ("a", "b"): ("subsumes", "a"), ("a", "c"): ("distinct", None), ("a", "d"): ("subsumes", "b"), ("a", "e"): ("uncertain", None), ("e", "f"): ("equivalent", None), ("e", "g"): ("uncertain", None),
        ("d", "e"): ("subsumes", "a"), ("b", "h"): ("overlap", None), ("b", "i"): ("subsumes", "b"), ("d", "z"): ("equivalent", None),
    }
    pairs = spark.createDataFrame(list(expected), "a string, b string")
    rel = G.slot_relations(pairs, sigs, above)
    u = G.unify(pairs, rel)
    assert {(r["a"], r["b"]): (r["kind"], r["general"]) for r in u.collect()} == expected
    groups = {r["frame"]: r["group"] for r in G.coreferent(u).collect()}
    assert groups["a"] == groups["b"] == groups["d"] == groups["e"] == groups["f"] == groups["i"] and groups["c"] == "c" and groups["g"] == "g"
    n = {(r["a"], r["b"], r["side"], r["slot"]): r["values"] for r in G.folded_values(rel, sigs, above).collect()}
    assert n["a", "b", "b", "event"] == ["atm cash"] and n["a", "d", "a", "event"] == ["atm cash", "cash"] and n["b", "h", "b", "who"] == ["phd student"]


def test_decisions(spark):
    rows = [
        ("distinct", True, "subset", False, False, None), ("equivalent", False, "subset", False, False, None), ("equivalent", True, "subset", False, True, "unknown"), ("subsumes", True, "disjoint", False, False, "disjoint"),
        ("subsumes", True, "subset", True, False, "redundant"), ("overlap", True, "equal", False, False, "same_scope"), ("overlap", True, "overlapping", False, False, "crossing"), ("overlap", True, "superset", False, False, "conditional"),
    ]
    d = spark.createDataFrame(rows, "kind string, comm boolean, rel string, match boolean, hedged boolean, expected string")
    d = d.withColumn("decision", G.decision(F.col("kind"), F.col("comm"), F.col("rel"), F.col("match"), F.col("hedged"))).withColumn("score", F.lit(0.5)).withColumn("k", F.lit(1))
    assert all(r["decision"] == r["expected"] for r in d.collect())
    assert [r["decision"] for r in G.strongest(d, ["k"]).collect()] == ["conditional"]


def test_running_sums_do_not_need_a_key(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([("k", round(rng.random(), 2), rng.random() < 0.4) for _ in range(2000)] + [("k", None, True), ("k", 0.5, None)], "k string, s double, y boolean").repartition(5)
    plain = sorted(map(tuple, M.threshold_table(d, "s", "y", ["k"]).drop("k").collect()))
    assert sorted(map(tuple, M.threshold_table(d, "s", "y").select("t", "pos", "neg", "tp", "fp", "n_pos", "n_neg").collect())) == plain and len(plain) > 90
    assert M.auc(d, "s", "y").first()["auc"] == M.auc(d, "s", "y", ["k"]).first()["auc"]
    assert M.threshold_table(d.limit(0), "s", "y").count() == 0
