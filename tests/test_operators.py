"""Hand-checked frames and invariants of the core operators."""
import itertools
import random

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.urls import canonical_page
from quernstone.operators import inference as I
from quernstone.operators import metrics as M
from quernstone.operators import pairs as P
from quernstone.operators import retrieval as R
from quernstone.operators import scope as S
from quernstone.operators.chunking import pack_elements, pack_sentences
from quernstone.plans.components import components
from quernstone.plans.skew import salted_join
from quernstone.queries.dataset import snippet_pages
from quernstone.queries.pairs import ORACLES, similar_questions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens_and_normal_forms(spark):
    assert one(spark, T.tokens(F.lit("Fee, 3% -- WAIVED!"))) == ["fee", "3", "waived"]
    assert one(spark, T.squad_normal(F.lit("The  AFL, (a) league."))) == "afl league"
    assert one(spark, T.holds_tokens(F.lit("the AFLX league"), F.lit("AFL"))) is False
    assert one(spark, T.figures(F.lit("£1,270 and 2.50 and 1270"))) == ["1270", "2.5"]
    assert one(spark, T.tag_of(F.lit("<li>a\nb</li>"))) == "li" and one(spark, T.tag_of(F.lit("<LI>a</LI>"))) == "li"
    assert one(spark, T.tag_of(F.lit(" bare\u00a0"))) == "p" and one(spark, T.text_of(F.lit(" bare\u00a0"))) == "bare"
    assert one(spark, T.word_count(F.lit("one\u00a0two\n three"))) == 3


@pytest.mark.parametrize("url", ["https://a.example/x", "HTTP://A.example/x/", "http://www.a.example/x#top", "https://a.example:443/x?utm_source=n&page=1", " https://a.example//x?print=true "])
def test_spellings_of_one_page(spark, url):
    assert one(spark, canonical_page(F.lit(url))) == "a.example/x"


def test_other_pages_stay_apart(spark):
    assert one(spark, canonical_page(F.lit("https://a.example/x?page=2&lang=cy"))) == "a.example/x?lang=cy&page=2"
    assert one(spark, canonical_page(F.lit("  "))) is None


def test_packing():
    assert pack_elements([3, 3, 9, 2], ["p"] * 4, 6, False) == [(0, 2), (2, 3), (3, 4)]
    assert pack_elements([1, 1, 1, 1], ["p", "h2", "p", "p"], 9, True) == [(0, 1), (1, 4)]
    assert pack_elements([5, 1, 5], ["p", "h3", "p"], 6, True) == [(0, 1), (1, 3)]
    assert pack_elements([5, 1, 6], ["p", "h3", "p"], 6, True) == [(0, 1), (1, 3)]  # a heading goes with what follows, past the budget
    assert pack_elements([], [], 6, True) == []
    assert pack_sentences([100, 30, 40, 5], 140, 50) == [(0, 4)]
    assert pack_sentences([100, 60, 90], 140, 50) == [(0, 1), (1, 2), (2, 3)]


def test_reciprocal_ranks_tie_by_id(spark):
    r = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "qid int, doc_id string, rank bigint")
    got = R.reciprocal_rank_fusion({"a": r(["z"]), "b": r(["y"]), "c": r(["x", "z"])}, 5).orderBy("rank").collect()
    assert [g["doc_id"] for g in got] == ["z", "x", "y"]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_wilson_and_binomial(spark):
    low, high = I.wilson(F.lit(45), F.lit(50))
    assert one(spark, low) == pytest.approx(0.78640, abs=1e-4) and one(spark, high) == pytest.approx(0.95652, abs=1e-4)
    low, high = I.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)
    assert one(spark, I.binomial_tail(F.lit(20), F.lit(5))) == pytest.approx(0.0041, abs=1e-4)
    assert one(spark, I.binomial_tail(F.lit(3), F.lit(6))) == pytest.approx(0.508, abs=1e-3)
    assert one(spark, I.binomial_tail(F.lit(0), F.lit(0))) == 1.0


def test_holm_keeps_order(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")
    got = {r["t"]: r["p_adjusted"] for r in I.holm(d, "p", "t").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_auc_counts_ties_half(spark):
    d = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, y boolean")
    assert M.auc(d, "s", "y").first()["auc"] == pytest.approx(3.5 / 4)


def test_kappa_of_one_category_is_withheld(spark):
    d = spark.createDataFrame([("k", "x", "x")] * 4, "k string, a string, b string")
    r = M.kappa(d, "a", "b", ["k"]).first()
    assert r["kappa"] is None and r["observed"] == 1.0


def attr(name, kind, values=None, lo=None, hi=None, flag=None):
    return {"name": name, "kind": kind, "values": sorted(values or []), "lo": float("-inf" if lo is None else lo), "hi": float("inf" if hi is None else hi), "flag": flag, "text": None}


# every scope over a colour, a weight and whether something is fragile, and every parcel that tells scopes apart
COLOURS = [None, attr("colour", "categorical", ["red"]), attr("colour", "ordered_tier", ["blue", "red"]), attr("colour", "categorical", ["green"])]
WEIGHTS = [None, attr("kilos", "numeric_range", lo=2), attr("kilos", "numeric", lo=1, hi=2), attr("kilos", "numeric", hi=1)]
FRAGILE = [None, attr("fragile", "boolean", flag=True), attr("fragile", "boolean", flag=False)]
SCOPES = [[a for a in x if a] for x in itertools.product(COLOURS, WEIGHTS, FRAGILE)]
PARCELS = list(itertools.product(["red", "blue", "green", "plaid"], [0.5, 1, 1.5, 2, 9], [True, False]))


def lies_in(scope, parcel):
    inside = {"colour": lambda a: parcel[0] in a["values"], "kilos": lambda a: a["lo"] <= parcel[1] <= a["hi"], "fragile": lambda a: a["flag"] == parcel[2]}
    return all(inside[a["name"]](a) for a in scope)


def test_satisfiability_against_enumeration():
    rng = random.Random(5)
    typed = [(s, S.constraints(s)) for s in SCOPES]
    for _ in range(1500):
        ins, outs = rng.choices(typed, k=rng.randrange(4)), rng.choices(typed, k=rng.randrange(4))
        expected = any(all(lies_in(s, p) for s, _ in ins) and not any(lies_in(s, p) for s, _ in outs) for p in PARCELS)
        assert S.satisfiable([c for _, c in ins], [c for _, c in outs]) == expected, (ins, outs)


def test_relations_against_enumeration(spark):
    held = [frozenset(p for p in PARCELS if lies_in(s, p)) for s in SCOPES]
    pairs = [(i, j) for i in range(1, len(SCOPES)) for j in range(1, len(SCOPES))]
    d = spark.createDataFrame([(i, SCOPES[i], j, SCOPES[j]) for i, j in pairs], f"i int, a array<{S.ATTRIBUTE}>, j int, b array<{S.ATTRIBUTE}>")
    got = {(r["i"], r["j"]): r["r"] for r in d.select("i", "j", S.scope_relation(F.col("a"), F.col("b"), F.lit(False), F.lit(False)).alias("r")).collect()}
    for i, j in pairs:
        if any(x["name"] == y["name"] and x["kind"] != y["kind"] for x in SCOPES[i] for y in SCOPES[j]):
            continue  # kinds that differ are not compared by what they hold
        a, b = held[i], held[j]
        assert got[i, j] == ("disjoint" if not a & b else "equal" if a == b else "subset" if a < b else "superset" if a > b else "overlapping"), (SCOPES[i], SCOPES[j])


def test_relations_that_nothing_decides(spark):
    text = attr("note", "free_text")
    red, light = [attr("colour", "categorical", ["red"])], [attr("kilos", "numeric", hi=1)]
    cases = [([], red, "unknown"), (red, [text], "unknown"), (red, [*red, text], "unknown"), ([attr("colour", "categorical", ["blue"])], [*red, text], "disjoint"), (red, light, "overlapping"), ([*red, attr("colour", "categorical", ["blue"])], [attr("colour", "categorical", ["blue"])], "equal")]
    d = spark.createDataFrame([(a, b, x) for a, b, x in cases], f"a array<{S.ATTRIBUTE}>, b array<{S.ATTRIBUTE}>, expected string")
    assert all(r["r"] == r["expected"] for r in d.select("expected", S.scope_relation(F.col("a"), F.col("b"), F.lit(False), F.lit(False)).alias("r")).collect())


def test_deep_taxonomies_close(spark):
    depth = 50
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(depth)] + [("n0", "n10"), ("x", None)], "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["distance"] for r in S.closure(edges).collect()}
    assert len(got) == (depth + 1) * (depth + 2) // 2 and got["n0", "n50"] == 41 and got["n0", "n9"] == 9 and got["n3", "n3"] == 0


def test_intervals_that_touch_merge(spark):
    d = spark.createDataFrame([("k", 0.0, 5.0), ("k", 5.0, 7.0), ("k", 8.0, 9.0), ("k", 3.0, 1.0)], "k string, lo double, hi double")
    assert sorted((r["lo"], r["hi"]) for r in S.merged_intervals(d, ["k"], "lo", "hi").collect()) == [(0.0, 7.0), (8.0, 9.0)]


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(1)
    sets = [(i, sorted(rng.sample("abcdefghij", rng.randint(1, 8)))) for i in range(80)]
    got = {(r["a"], r["b"]) for r in P.similar_sets(spark.createDataFrame(sets, "k int, t array<string>"), "k", "t", 0.6).collect()}
    least = {}
    for i, t in sets:
        least.setdefault(tuple(t), i)
    own = list(least.items())
    expected = {tuple(sorted((i, j))) for (s, i), (t, j) in itertools.combinations(own, 2) if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.6}
    assert got == expected


def test_pages_of_a_snippet_are_counted_before_the_join(spark, tmp_path):
    text = "When you leave the scheme you must tell the office of your district within "
    pages = [(i, f"https://x.example/{i}", "t", [f"<p>{text}{i % 3} days.</p>", f"<li>{text}{i % 3} days.</li>", f"<p>{text}{'a week ' * 20}</p>", "<p>short</p>"], "2024-01-01") for i in range(30)]
    spark.createDataFrame(pages, "doc bigint, url string, title string, elements array<string>, fetched_at string").write.parquet(f"{tmp_path}/guide_docs.parquet")
    d = snippet_pages(spark, str(tmp_path))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # else each page meets each other one that has the snippet
    assert [(r["home"], r["n_pages"], r["first_page"]) for r in d.orderBy("home").collect()] == [(i, 30, 0) for i in range(30)]


def test_similar_sets_meet_by_four_tokens(spark):
    rng = random.Random(4)
    base = [f"name{i % 40}" for i in range(400)]
    sets = [(i, sorted({base[i], f"kind{i % 7}", f"sort{i % 3}", *rng.sample("bcdefghijklmn", rng.randint(1, 14 - 4))})) for i in range(300)]
    sets += [(1000 + i, sorted({*t, "extra"})) for i, t in sets[:60]] + [(2000, ["a", "b", "c", "d"]), (2001, ["a", "b", "c", "d", "e"])]
    d = P.similar_sets(spark.createDataFrame(sets, "k int, t array<string>"), "k", "t", 0.8)
    least = {}
    for i, t in sets:
        least.setdefault(tuple(t), i)
    expected = {tuple(sorted((i, j))) for (s, i), (t, j) in itertools.combinations(list(least.items()), 2) if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.8}
    assert {(r["a"], r["b"]) for r in d.collect()} == expected and (2000, 2001) in expected and len(expected) > 40
    assert one(spark, P.subsets(F.array(*map(F.lit, "abcd")), 3)) == [list("abc"), list("abd"), list("acd"), list("bcd")]


def test_similar_sets_pair_all_copies(spark):
    rng = random.Random(6)
    sets = [(f"k{i:03d}", rng.sample("abcdefghi", rng.randint(3, 9))) for i in range(120)] + [("none", []), ("nothing", [])]
    sets += [(f"c{i:02d}", rng.sample("pqrstu", 6)) for i in range(12)] + [(f"d{i:02d}", [*"pqrstuv"]) for i in range(5)] + [(f"e{i}", ["only", "here"]) for i in range(3)]
    d = P.similar_sets(spark.createDataFrame(sets, "k string, t array<string>"), "k", "t", 0.8, copies=True)
    expected = {}
    for (i, s), (j, t) in itertools.combinations(sorted(sets), 2):
        common, either = len({*s} & {*t}), len({*s} | {*t})
        if either and common / either >= 0.8:
            expected[i, j] = (common, round(common / either, 6))
    got = d.collect()
    assert len(got) == len(expected) and {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in got} == expected
    assert ("c03", "c07") in expected and ("c03", "d04") in expected and ("e1", "e2") in expected


def test_similar_questions_of_equal_words(spark, tmp_path):
    asked = ["Can I claim the Starter Loan if I lost 2 jobs?", "Can I claim the Starter Loan if I lost 3 jobs?", "Can I claim the starter loan if I lost a job or jobs?", "Can I claim the Starter Loan if I lost 3 jobs?", "Is it?", "Is he?", None]
    spark.createDataFrame([(x,) for x in asked], "question string").write.parquet(f"{tmp_path}/questions.parquet")
    got = sorted((r["a"], r["b"], r["common"], r["jaccard"]) for r in similar_questions(spark, str(tmp_path)).collect())
    assert got == [(asked[0], asked[1], 5, 1.0), (asked[0], asked[2], 5, 0.833333), (asked[1], asked[2], 5, 0.833333)]
    assert compare(spark, duck(str(tmp_path)), similar_questions, ORACLES["similar_questions"], str(tmp_path)) == ""


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(90)] + [("hub", f"leaf{i}") for i in range(40)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("alone", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        find(a)
        if b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_salted_join_keeps_rows(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = big.join(small, "k", how), salted_join(big, small, "k", how, hot=[(0,), (6,)])
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.select(*plain.columns).collect()), key=str)


def test_regions_of_nested_and_crossing_frames(spark):
    frame = lambda k, outcome, attributes=(), default=False: {"frame": k, "outcome": outcome, "is_default": default, "attributes": list(attributes)}
    base = frame("b0", "no", default=True)
    adult, tier = frame("b1", "yes", [attr("age", "numeric", lo=18)]), frame("b2", "no", [attr("tier", "categorical", ["a"])])
    got = {r[0]: r[1:] for r in S.regions([base, adult, tier])}
    assert got == {"b0": ("b0", "no", "assigned"), "b0 b1": ("b1", "yes", "assigned"), "b0 b2": ("b2", "no", "assigned"), "b0 b1 b2": ("b1 b2", None, "contested")}
    assert ("", "", None, "uncovered") in S.regions([adult, tier])
    odd = [frame("free", "x", [attr("note", "free_text")]), frame("bare", "x"), frame("never", "x", [attr("age", "numeric", lo=5), attr("age", "numeric", hi=4)]), frame("mixed", "x", [attr("tier", "numeric", lo=1)])]
    status = {r[0]: r[3] for r in S.regions([tier, *odd])}
    assert status == {"free": "indeterminate", "bare": "indeterminate", "never": "discarded", "mixed": "indeterminate", "b2": "indeterminate", "": "uncovered"}
    with pytest.raises(ValueError):
        S.regions([base] * 9)
    rows = [("k", f["frame"], f["is_default"], f["attributes"], f["outcome"]) for f in (adult, tier)] + [("l", "b1", False, adult["attributes"], "you must pay"), ("l", "b2", False, tier["attributes"], "payment is due")]
    d = S.partition(spark.createDataFrame(rows, f"k string, frame string, is_default boolean, attributes array<{S.ATTRIBUTE}>, outcome string"), "k")
    assert {(r["k"], r["inside"]): r["status"] for r in d.collect()} == {("k", "b1"): "assigned", ("k", "b2"): "assigned", ("k", "b1 b2"): "contested", ("k", ""): "uncovered", ("l", "b1"): "assigned", ("l", "b2"): "assigned", ("l", "b1 b2"): "assigned", ("l", ""): "uncovered"}


def test_answers_and_regions_are_not_cut():
    from quernstone.operators.matching import conditional_score

    gold = [(f"word{i}", []) for i in range(7)]
    assert conditional_score(gold[:5], gold) == pytest.approx((5 / 7,) * 4)
    assert conditional_score([("x", []), *gold[5:]], gold) == pytest.approx((2 / 7,) * 4)
    frames = [{"frame": f"f{i:02}", "outcome": str(i), "attributes": [attr("age", "numeric", lo=10.0 * i, hi=10.0 * i + 5)]} for i in range(12)]
    assert sorted(r[0] for r in S.every_region(frames)) == ["", *(f"f{i:02}" for i in range(12))]
