"""Statistical inference: closed forms as expressions, resampling as replicate tables with a hashed generator.

Resampling never copies rows: units are first reduced to one row of sums each, and a replicate draws units by index.
"""
from __future__ import annotations

import math
from hashlib import md5
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) where n is 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.lit(0.0)), F.coalesce(F.when(n > 0, F.least(F.lit(1.0), mid + half)), F.lit(1.0))


def binomial_tail(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c at one half; 1 where both are 0."""
    n, k = b + c, F.least(b, c)
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1)).cast("int")), F.lit(0.0), lambda s, j: s + F.when(j <= i, F.log((n - j + 1).cast("double")) - F.log(j.cast("double"))).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(log_choose(i) - n * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


# A rational approximation of erfc (relative error under 1.2e-7), and of the normal quantile (Acklam, under 1.2e-9).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def _horner(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(c[0])
    for a in c[1:]:
        out = out * x + a
    return out


def let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def erfc(x: Column) -> Column:
    tail = lambda z: let(1 / (1 + 0.5 * z), lambda t: t * F.exp(-z * z + _horner(ERFC[::-1], t)))
    return let(x, lambda v: F.when(v >= 0, tail(F.abs(v))).otherwise(2 - tail(F.abs(v))))


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def normal_quantile(p: Column) -> Column:
    """Of p in (0, 1); null outside."""
    centre = lambda q: let(q * q, lambda r: q * _horner(CENTRE[0], r) / _horner(CENTRE[1], r))
    tail = lambda u: let(F.sqrt(-2 * F.log(u)), lambda r: _horner(TAIL[0], r) / _horner(TAIL[1], r))
    return let(p, lambda v: F.when((v <= 0) | (v >= 1), F.lit(None).cast("double")).when(v < 0.02425, tail(v)).when(v > 1 - 0.02425, -tail(1 - v)).otherwise(centre(v - 0.5)))


def quantile(p: float) -> float:
    """The normal quantile of a fixed level."""
    return NormalDist().inv_cdf(p)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided p of b against c: exact under 25 in all, else chi-square with continuity correction."""
    n = b + c
    chi = (F.abs(b - c) - 1) * (F.abs(b - c) - 1) / F.greatest(n, F.lit(1))
    exact = binomial_tail(F.when(n < 25, b).otherwise(F.lit(0)), F.when(n < 25, c).otherwise(F.lit(0)))
    return F.when(n < 25, exact).otherwise(F.least(F.lit(1.0), erfc(F.sqrt(chi / 2))))


def paired_size(effect: Column, discordant: Column, alpha: float = 0.05, power: float = 0.8) -> tuple[Column, Column]:
    """(discordant items, items) that a McNemar test needs to see a difference of ``effect``; 0 where every discordant one falls one way."""
    za, zb = quantile(1 - alpha / 2), quantile(power)
    p = 0.5 + effect / (2 * discordant)
    need = F.ceil(F.pow(za * 0.5 + zb * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0))), F.lit(2.0)) / F.pow(p - 0.5, F.lit(2.0)))
    return F.when(p >= 1, F.lit(0)).otherwise(need).cast("bigint"), F.when(p >= 1, F.lit(0)).otherwise(F.ceil(need / discordant)).cast("bigint")


def proportion_size(baseline: Column, effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Items in each of two independent groups that tell ``baseline`` from ``baseline + effect``."""
    za, zb = quantile(1 - alpha / 2), quantile(power)
    q, m = baseline + effect, baseline + effect / 2
    spread = za * F.sqrt(2 * m * (1 - m)) + zb * F.sqrt(baseline * (1 - baseline) + q * (1 - q))
    return F.ceil(spread * spread / (effect * effect)).cast("bigint")


def bca(units: DataFrame, keys: list[str], draws: int = 200, alpha: float = 0.05, seed: str = "b", one_sided: bool = False) -> DataFrame:
    """(keys, point, low, high, n_units) of a ratio of sums: percentile levels corrected for bias (share of draws below the point) and
    acceleration (jackknife). ``one_sided``: the lower bound alone, ``high`` null. Under three units the plain percentiles stand."""
    units = materialize(units, "units")
    d = materialize(cluster_bootstrap(units, keys, draws, seed), "draws")
    point = units.groupBy(*keys).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("point"))
    a = jackknife(units, keys, places=15)
    below = d.join(point, keys).groupBy(*keys).agg(F.avg((F.col("mean") < F.col("point")).cast("double")).alias("below"), F.max("point").alias("point"), F.count(F.lit(1)).alias("b"))
    below = below.withColumn("z0", normal_quantile(F.greatest(1 / (F.col("b") + 1), F.least(1 - 1 / (F.col("b") + 1), F.col("below")))))
    z0 = F.col("z0")

    def level(p: float) -> Column:
        z = z0 + quantile(p)
        denominator = 1 - F.col("acceleration") * z
        moved = F.when(denominator <= 0, F.lit(0.0 if p < 0.5 else 1.0)).otherwise(normal_cdf(z0 + z / denominator))
        return F.when(F.col("n_units") < 3, F.lit(p)).otherwise(moved)

    lo, hi = (alpha, 1 - 1e-9) if one_sided else (alpha / 2, 1 - alpha / 2)
    levels = below.join(a, keys).select(*keys, "point", "n_units", level(lo).alias("lo"), level(hi).alias("hi"))
    w = Window.partitionBy(*keys)
    r = d.withColumn("r", F.row_number().over(w.orderBy("mean")) - 1).withColumn("b", F.count(F.lit(1)).over(w)).join(levels, keys)
    at = lambda q: F.round(F.max(F.when(F.col("r") == F.least(F.floor(F.col(q) * F.col("b")), F.col("b") - 1), F.col("mean"))), 6)
    high = F.lit(None).cast("double") if one_sided else at("hi")
    return r.groupBy(*keys).agg(F.round(F.max("point"), 6).alias("point"), at("lo").alias("low"), high.alias("high"), F.max("n_units").alias("n_units"))


def sign_flip_exact(sums: DataFrame, keys: list[str], most: int = 16) -> DataFrame:
    """p of the mean difference by all 2^n signs, of keys with at most ``most`` units (keys, unit, s). 1 where all differences are 0."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("unit")) - 1
    packed = sums.withColumn("i", i).where(F.col("i") <= most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("d")).where(F.size("d") <= most)
    each = packed.select(*keys, "d", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("d")).cast("int") - 1)).alias("m"))
    bit = lambda j: F.when(F.call_function("shiftright", F.col("m"), j).bitwiseAND(1) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    total = F.aggregate(F.transform("d", lambda x, j: x * bit(j)), F.lit(0.0), lambda a, x: a + x)
    obs = F.abs(F.aggregate("d", F.lit(0.0), lambda a, x: a + x))
    return each.select(*keys, F.size("d").alias("n"), F.round(obs, 9).alias("obs"), (F.abs(total) >= obs - 1e-9).cast("double").alias("hit")).groupBy(*keys, "n", "obs").agg(F.round(F.avg("hit"), 9).alias("p"))


def holm(df: DataFrame, p: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Holm's step-down over one family (a row for each test): adjusted p, and whether it is rejected."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(p, name)
    m = df.withColumn("__m", F.count(F.lit(1)).over(every)).withColumn("__i", F.row_number().over(order))
    adjusted = F.max(F.least(F.lit(1.0), (F.col("__m") - F.col("__i") + 1) * F.col(p))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("p_adjusted", F.round(adjusted, 9)).withColumn("rejected", F.col("p_adjusted") < alpha).drop("__m", "__i")


def hashed_index(seed: str, draw: Column, i: Column, n: Column) -> Column:
    """A number in [0, n) for place i of a draw: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), draw, i)), 1, 8), 16, 10).cast("bigint") % n


#: Units of a block; a task holds the counts of all draws for one block.
BLOCK = 32_768


def hashed_indexes(seed: str, draw: int, n: int):
    """The 32 bits that ``hashed_index`` reduces, of the places 0 to n - 1 of a draw."""
    import numpy as np

    one = lambda i: md5(f"{seed}|{draw}|{i}".encode()).digest()[:4]
    return np.concatenate([np.empty(0, "u4"), *[np.frombuffer(b"".join([one(i) for i in range(lo, min(lo + BLOCK, n))]), ">u4").astype("u4") for lo in range(0, n, BLOCK)]])


def resampled(units: DataFrame, keys: list[str], sums: list[str], draws: int, seed: str, block: int = BLOCK) -> DataFrame:
    """``units`` (keys, unit, sums) to (keys, draw, sums): the units of a key drawn with replacement, as many as there are.

    Which units a draw takes depends on its number and on the number of units alone. So a task counts how often each unit is in
    its draws, hashing a place once for all keys, and the counts, a byte for each unit and draw, go to the block that has the units.
    No row is made for a unit drawn, and nothing of the units' size goes to the driver: it has the number of units of each key.
    """
    placed = numbered(units.dropna(subset=keys) if keys else units, *keys, "unit").select(*keys, "i", *[F.col(c).cast("double").alias(c) for c in sums])
    sizes = placed.groupBy(*keys).agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("m")).where("m > 0")
    sizes = materialize(sizes, "sizes")  # read at the end too
    groups = [(r["start"], r["m"]) for r in sizes.select("start", "m").collect()]  # a row for each key
    most, every = max([m for _, m in groups], default=0), sum(m for _, m in groups)

    def count(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for draw in batch["id"].tolist():
                h, times = hashed_indexes(seed, draw, most), np.zeros(every, "u4")
                for start, m in groups:
                    times[start : start + m] = np.bincount(h[:m] % m, minlength=m)
                times = times.astype("u1") if times.max(initial=0) < 256 else times
                yield pd.DataFrame([(lo // block, draw, times[lo : lo + block].tobytes()) for lo in range(0, every, block)], columns=["block", "draw", "times"])

    def add(own, counts):
        import numpy as np
        import pandas as pd

        own = own.sort_values("i")
        lo, values = int(own["i"].iloc[0]), own[sums].to_numpy("float64")
        parts = [(start, max(start - lo, 0), min(start + m - lo, len(own))) for start, m in groups if start < lo + len(own) and start + m > lo]
        out = []
        for draw, times in zip(counts["draw"].tolist(), counts["times"]):
            t = np.frombuffer(times, "u1" if len(times) == len(own) else "u4").astype("float64")
            out += [(start, draw, *(t[a:z] @ values[a:z])) for start, a, z in parts]
        return pd.DataFrame(out, columns=["start", "draw", *sums])

    spark = units.sparkSession
    times = spark.range(0, draws, 1, max(1, draws // 4)).mapInPandas(count, "block bigint, draw int, times binary")
    by = placed.select(F.floor(F.col("i") / block).alias("block"), "i", *sums).groupBy("block")
    parts = by.cogroup(times.groupBy("block")).applyInPandas(add, ", ".join(["start bigint", "draw int", *[f"`{c}` double" for c in sums]]))
    return parts.groupBy("start", "draw").agg(*[F.sum(c).alias(c) for c in sums]).join(sizes, "start").select(*keys, "draw", *sums)


def cluster_bootstrap(units: DataFrame, keys: list[str], draws: int = 200, seed: str = "b") -> DataFrame:
    """``units`` (keys, unit, s, n: a row for each cluster) to (keys, draw, mean): clusters drawn with replacement. A draw in which n
    sums up to nothing has no mean."""
    return resampled(units, keys, ["s", "n"], draws, seed).select(*keys, "draw", F.try_divide("s", "n").alias("mean"))


def percentile_interval(draws: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Order statistics int(q * B) of the draws."""
    r = draws.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).withColumn("b", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda q: F.max(F.when(F.col("r") == F.least(F.floor(F.lit(q) * F.col("b")), F.col("b") - 1), F.col(value)))
    return r.groupBy(*keys).agg(F.round(at(alpha / 2), 6).alias("low"), F.round(at(1 - alpha / 2), 6).alias("high"), F.max("b").alias("n_draws"))


def jackknife(units: DataFrame, keys: list[str], places: int = 6) -> DataFrame:
    """Acceleration of BCa from leave-one-out means, which are sums less a row."""
    part = Window.partitionBy(*keys)
    leave = units.withColumn("v", F.try_divide(F.sum("s").over(part) - F.col("s"), F.sum("n").over(part) - F.col("n")))
    centred = leave.withColumn("d", F.avg("v").over(part) - F.col("v"))
    third, second = F.sum(F.pow("d", F.lit(3.0))), F.sum(F.pow("d", F.lit(2.0)))
    return centred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.round(F.when(second > 1e-18, third / (6 * F.pow(second, F.lit(1.5)))).otherwise(0.0), places).alias("acceleration"))


def sign_flip(sums: DataFrame, flips: int = 2000, seed: str = "s") -> DataFrame:
    """p of the mean difference under random signs of cluster sums (key, s: a row for each cluster); +1 corrected."""
    every = sums.select(F.sum("s").alias("obs"), F.count(F.lit(1)).alias("n_clusters"))  # one row
    d = sums.select("key", "s", F.explode(F.sequence(F.lit(0), F.lit(flips - 1))).alias("draw"))
    sign = F.when(hashed_index(seed, F.col("draw").cast("string"), F.col("key").cast("string"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    flipped = d.groupBy("draw").agg(F.sum(sign * F.col("s")).alias("t"))
    hit = F.abs("t") >= F.abs("obs") - 1e-9
    return flipped.crossJoin(F.broadcast(every)).groupBy("obs", "n_clusters").agg(F.round((F.sum(hit.cast("bigint")) + 1) / (F.count(F.lit(1)) + 1), 6).alias("p")).withColumn("obs", F.round("obs", 6))


def auc_interval(a: Column, n_pos: Column, n_neg: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Closed-form interval of an AUC from the numbers of positives and negatives."""
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    half = z * F.sqrt((a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)) / (n_pos * n_neg))
    return a - half, a + half


def paired_bootstrap(units: DataFrame, draws: int = 200, alpha: float = 0.05, seed: str = "b") -> DataFrame:
    """``units`` (unit, sa, na, sb, nb) to one row (difference, low, high, p_at_most_zero): both ratios on the same draws."""
    units = materialize(units, "units")
    ratio = lambda s, m: F.try_divide(F.sum(s), F.sum(m))
    of = lambda s, m: F.try_divide(F.col(s), F.col(m))
    means = resampled(units, [], ["sa", "na", "sb", "nb"], draws, seed).select("draw", (of("sa", "na") - of("sb", "nb")).alias("mean")).where("mean IS NOT NULL")
    every = Window.partitionBy(F.lit(0))  # a row for each draw
    r = means.withColumn("r", F.row_number().over(every.orderBy("mean")) - 1).withColumn("b", F.count(F.lit(1)).over(every))
    at = lambda q: F.round(F.max(F.when(F.col("r") == F.least(F.floor(F.lit(q) * F.col("b")), F.col("b") - 1), F.col("mean"))), 6)
    out = r.agg(at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"), F.round(F.avg((F.col("mean") <= 0).cast("int")), 6).alias("p_at_most_zero"))
    return units.agg(F.round(ratio("sa", "na") - ratio("sb", "nb"), 6).alias("difference")).crossJoin(out)  # one row each


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with i, the place of each row in the order of columns (nulls last), from 0: sorted in ranges, numbered in each, and moved by the sizes
    of the ranges before. No window over all rows."""
    by = [F.asc_nulls_last(c) for c in order]
    ranged = df.repartitionByRange(*by).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = ranged.withColumn("i", F.row_number().over(Window.partitionBy("__p").orderBy(*by)) - 1)
    return own.join(offsets, "__p").withColumn("i", F.col("i") + F.col("__before")).drop("__p", "__n", "__before")


def mcnemar_power(grid: DataFrame, discordance: float, alpha: float = 0.05) -> DataFrame:
    """``grid`` (n, delta) to (n, delta, power): over all numbers m of discordant items and b of those one way, the chance of each that
    the exact test rejects. For design sizes: n of some hundreds at most."""
    choose = lambda n, k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda s, j: s + F.when(j <= k, F.log((n - j + 1).cast("double")) - F.log(j.cast("double"))).otherwise(0.0))
    d, n, m, b = F.lit(discordance), F.col("n"), F.col("m"), F.col("b")
    g = grid.select("n", "delta", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("m")).select("n", "delta", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), m)).alias("b"))
    win = (d + F.col("delta")) / (2 * d)
    lose = F.greatest(1 - win, F.lit(0.0))
    chance = F.exp(choose(n, m) + m * F.log(d) + (n - m) * F.log(1 - d)) * F.exp(choose(m, b)) * F.pow(win, b.cast("double")) * F.pow(lose, (m - b).cast("double"))
    rejected = binomial_tail(b, m - b) <= alpha
    return g.groupBy("n", "delta").agg(F.round(F.sum(F.when(rejected, chance).otherwise(0.0)), 6).alias("power"))
