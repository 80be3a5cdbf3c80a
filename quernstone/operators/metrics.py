"""Evaluation metrics as aggregations and windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))


def binary_scores(df: DataFrame, gold: Column, predicted: Column, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, F1, accuracy by ``keys``; an empty denominator gives 0."""
    c = df.groupBy(*keys).agg(count_if(gold & predicted).alias("tp"), count_if(~gold & predicted).alias("fp"), count_if(gold & ~predicted).alias("fn"), count_if(~gold & ~predicted).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"), F.round(ratio(F.col("tp") + F.col("tn"), total), 6).alias("accuracy"))


def label_scores(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Per label support, predicted count, precision, recall, F1, from the cells of the confusion matrix."""
    cells = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("n_predicted"))
    j = rows.join(cols, "label", "full").fillna(0)
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("n_predicted"))
    return j.select("label", "support", "n_predicted", "tp", F.round(ratio(F.col("tp"), F.col("n_predicted")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("support")), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def threshold_table(df: DataFrame, score: str, label: str, keys: list[str] = []) -> DataFrame:
    """Counts at every distinct score taken as threshold (score >= t): pre-aggregated by score, then running sums."""
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("t")).agg(count_if(F.col(label)).alias("pos"), count_if(~F.col(label)).alias("neg"))
    if not keys:
        return _running_over_all(by)
    part = Window.partitionBy(*keys)
    run = part.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return by.select(*keys, "t", "pos", "neg", F.sum("pos").over(run).alias("tp"), F.sum("neg").over(run).alias("fp"), F.sum("pos").over(part).alias("n_pos"), F.sum("neg").over(part).alias("n_neg"))


def _running_over_all(by: DataFrame) -> DataFrame:
    """The same without keys, and without one task for all: ranges of the scores are summed each, then moved by the sums before."""
    d = materialize(by.repartitionByRange(F.desc("t")).withColumn("p", F.spark_partition_id()), "ranges")
    sums = d.groupBy("p").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))  # a row for each range
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    moved = sums.select("p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b{c}") for c in ("sp", "sn")], F.sum("sp").over(every).alias("n_pos"), F.sum("sn").over(every).alias("n_neg"))
    run = Window.partitionBy("p").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    own = d.withColumn("tp", F.sum("pos").over(run)).withColumn("fp", F.sum("neg").over(run)).join(moved, "p")
    return own.select("t", "pos", "neg", (F.col("tp") + F.col("bsp")).alias("tp"), (F.col("fp") + F.col("bsn")).alias("fp"), "n_pos", "n_neg")


def auc(df: DataFrame, score: str, label: str, keys: list[str] = []) -> DataFrame:
    """Mann-Whitney AUC with ties counted half, from the threshold table."""
    t = threshold_table(df, score, label, keys)
    wins = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg"))
    return t.groupBy(*keys).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.round(F.try_divide(wins, F.max(F.col("n_pos").cast("double") * F.col("n_neg"))), 6).alias("auc"))


def best_threshold(df: DataFrame, score: str, label: str, keys: list[str] = []) -> DataFrame:
    """The threshold of highest F1, of equal ones the higher; and the one of highest accuracy, of equal ones the lower."""
    t = threshold_table(df, score, label, keys)
    f1 = F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), 9)
    acc = F.round(ratio(F.col("tp") + F.col("n_neg") - F.col("fp"), F.col("n_pos") + F.col("n_neg")), 9)
    best = t.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), F.col("t").alias("t"))).alias("f"), F.max(F.struct(acc.alias("acc"), (-F.col("t")).alias("t"))).alias("a"))
    return best.select(*keys, F.round("f.f1", 6).alias("f1"), F.col("f.t").alias("f1_threshold"), F.round("a.acc", 6).alias("accuracy"), (-F.col("a.t")).alias("accuracy_threshold"))


def kappa(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Cohen's kappa by ``keys``; null where only one category was used."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    ra = cells.groupBy(*keys, F.col(a).alias("c")).agg(F.sum("n").alias("na"))
    rb = cells.groupBy(*keys, F.col(b).alias("c")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, [*keys, "c"], "full").fillna(0, ["na", "nb"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    seen = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    n = F.col("n").cast("double")
    pe = F.col("chance") / (n * n)
    return seen.join(chance, keys).select(*keys, "n", F.round(F.col("same") / n, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.when(F.col("chance") < F.col("n") * F.col("n"), (F.col("same") / n - pe) / (1 - pe)), 6).alias("kappa"))
