"""Inference against plain Python: distributions, exact tests, resampling on the same draws, power."""
import hashlib
import itertools
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quernstone.operators import inference as I


def values(spark, column, xs):
    return [r["v"] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normal_distribution(spark):
    xs = [-6, -2.5, -1, -0.1, 0, 0.3, 1.96, 5]
    assert values(spark, I.normal_cdf, xs) == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-7)
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    assert values(spark, I.normal_quantile, ps) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-6)
    assert values(spark, I.normal_quantile, [0, 1]) == [None, None]


def test_mcnemar_is_exact_for_few_and_chi_square_for_many(spark):
    got = {(r["b"], r["c"]): r["p"] for r in spark.createDataFrame([(3, 6), (0, 0), (20, 5), (5, 20), (400, 300)], "b bigint, c bigint").select("b", "c", I.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()}
    assert got[3, 6] == pytest.approx(0.5078125) and got[0, 0] == 1.0
    assert got[20, 5] == got[5, 20] == pytest.approx(0.0051, abs=1e-4)
    assert got[400, 300] == pytest.approx(math.erfc(math.sqrt(99**2 / 700 / 2)), rel=1e-5)


def test_sign_flips_by_enumeration(spark):
    rng = random.Random(3)
    data = {"a": [rng.gauss(0.4, 1) for _ in range(9)], "zero": [0.0] * 4, "one": [2.5], "many": [1.0] * 20}
    rows = [(k, f"u{i:02}", x) for k, d in data.items() for i, x in enumerate(d)]
    got = {r["k"]: r["p"] for r in I.sign_flip_exact(spark.createDataFrame(rows, "k string, unit string, s double"), ["k"]).collect()}
    d = data["a"]
    brute = sum(abs(sum(s * x for s, x in zip(signs, d))) >= abs(sum(d)) - 1e-9 for signs in itertools.product((1, -1), repeat=9)) / 2**9
    assert got == {"a": pytest.approx(brute), "zero": 1.0, "one": 1.0}  # more than sixteen units are not enumerated


def drawn(units, draws, seed="b"):
    pick = lambda d, i: units[int(hashlib.md5(f"{seed}|{d}|{i}".encode()).hexdigest()[:8], 16) % len(units)]
    return [[pick(d, i) for i in range(len(units))] for d in range(draws)]


def test_bca_against_plain_python(spark):
    rng = random.Random(7)
    units = [(f"u{i:03}", float(rng.randint(0, 3)) ** 2, rng.randint(1, 4)) for i in range(40)]
    n01 = NormalDist()
    mean = lambda us: sum(u[1] for u in us) / sum(u[2] for u in us)
    means = sorted(mean(s) for s in drawn(units, 200))
    point, b = mean(units), 200
    z0 = n01.inv_cdf(min(max(sum(m < point for m in means) / b, 1 / (b + 1)), 1 - 1 / (b + 1)))
    jack = [mean(units[:i] + units[i + 1 :]) for i in range(len(units))]
    centre = sum(jack) / len(jack)
    a = sum((centre - j) ** 3 for j in jack) / (6 * sum((centre - j) ** 2 for j in jack) ** 1.5)
    level = lambda p: n01.cdf(z0 + (z0 + n01.inv_cdf(p)) / (1 - a * (z0 + n01.inv_cdf(p))))
    at = lambda p: means[min(int(level(p) * b), b - 1)]
    d = spark.createDataFrame([("k", *u) for u in units], "k string, unit string, s double, n bigint")
    r = I.bca(d, ["k"]).first()
    assert (r["point"], r["low"], r["high"]) == pytest.approx((point, at(0.025), at(0.975)), abs=1e-6)
    assert I.bca(d, ["k"], one_sided=True).first()["low"] == pytest.approx(at(0.05), abs=1e-6)
    two = I.bca(d.limit(2), ["k"]).first()  # under three units the plain percentiles stand
    assert two["n_units"] == 2 and two["low"] <= two["point"] <= two["high"]


def test_paired_draws_make_no_row_for_each_unit_and_draw(spark):
    rng = random.Random(5)
    units = [(f"u{i:03}", float(rng.randint(0, 2)), 2.0, float(rng.randint(0, 2)), 2.0) for i in range(50)]
    d = I.paired_bootstrap(spark.createDataFrame(units, "unit string, sa double, na double, sb double, nb double"))
    assert "explode" not in d._jdf.queryExecution().executedPlan().toString()  # such rows were broadcast through the driver
    ratio = lambda us, s: sum(u[s] for u in us) / sum(u[s + 1] for u in us)
    means = sorted(ratio(us, 1) - ratio(us, 3) for us in drawn(units, 200))
    r = d.first()
    assert (r["difference"], r["low"], r["high"]) == pytest.approx((ratio(units, 1) - ratio(units, 3), means[5], means[195]), abs=1e-6)
    assert r["p_at_most_zero"] == pytest.approx(sum(m <= 0 for m in means) / 200, abs=1e-6)


def test_draws_over_blocks_and_keys(spark):
    rng = random.Random(9)
    units = {k: [(k, f"u{i:03}", float(rng.randint(0, 9)), rng.randint(1, 4)) for i in range(n)] for k, n in (("a", 37), ("b", 1), ("c", 90))}
    d = spark.createDataFrame([u for us in units.values() for u in us] + [(None, "u", 1.0, 1)], "k string, unit string, s double, n bigint")
    got = {(r["k"], r["draw"]): (r["s"], r["n"]) for r in I.resampled(d, ["k"], ["s", "n"], 20, "x", block=16).collect()}
    assert got == {(k, i): (sum(u[2] for u in s), sum(u[3] for u in s)) for k, us in units.items() for i, s in enumerate(drawn(us, 20, "x"))}


def test_draws_without_a_denominator_have_no_mean(spark):
    d = spark.createDataFrame([("k", "a", 1.0, 1), ("k", "b", 0.0, 0), ("none", "a", 0.0, 0)], "k string, unit string, s double, n int")
    got = I.cluster_bootstrap(d, ["k"], 40).groupBy("k").agg(F.count(F.lit(1)).alias("draws"), F.count("mean").alias("means")).collect()
    both = sum(any(u == "a" for u in s) for s in drawn(["a", "b"], 40))
    assert {r["k"]: (r["draws"], r["means"]) for r in got} == {"k": (40, both), "none": (40, 0)} and 0 < both < 40


def test_bca_of_a_single_unit(spark):
    d = spark.createDataFrame([("one", "a", 1.0, 2)], "k string, unit string, s double, n bigint")
    for one_sided in (False, True):
        b = I.bca(d, ["k"], one_sided=one_sided)
        assert "explode" not in b._jdf.queryExecution().executedPlan().toString()
        r = b.first()
        assert (r["point"], r["low"], r["high"], r["n_units"]) == (0.5, 0.5, None if one_sided else 0.5, 1)


def test_rows_are_numbered_across_ranges(spark):
    d = spark.range(1000).select(F.concat(F.lit("k"), F.lpad((F.col("id") * 7919 % 1000).cast("string"), 4, "0")).alias("k"))
    got = [(r["k"], r["i"]) for r in I.numbered(d.repartition(7), "k").orderBy("k").collect()]
    assert got == [(f"k{i:04}", i) for i in range(1000)]


def test_sizes_and_power(spark):
    disc, items = I.paired_size(F.lit(0.1), F.lit(0.2))
    r = spark.range(1).select(disc.alias("d"), items.alias("n"), I.proportion_size(F.lit(0.3), F.lit(0.1)).alias("u")).first()
    za, zb = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)
    need = math.ceil((za * 0.5 + zb * math.sqrt(0.75 * 0.25)) ** 2 / 0.25**2)
    assert (r["d"], r["n"]) == (need, math.ceil(need / 0.2)) and r["u"] == math.ceil((za * math.sqrt(2 * 0.35 * 0.65) + zb * math.sqrt(0.3 * 0.7 + 0.4 * 0.6)) ** 2 / 0.01)
    p = lambda b, m: min(1.0, 2 * sum(math.comb(m, i) for i in range(min(b, m - b) + 1)) / 2**m)
    n, d, delta = 12, 0.4, 0.3
    q = (d + delta) / (2 * d)
    brute = sum(math.comb(n, m) * d**m * (1 - d) ** (n - m) * sum(math.comb(m, b) * q**b * (1 - q) ** (m - b) for b in range(m + 1) if p(b, m) <= 0.05) for m in range(n + 1))
    assert I.mcnemar_power(spark.createDataFrame([(n, delta)], "n bigint, delta double"), d).first()["power"] == pytest.approx(brute, abs=1e-6)
