"""Joins that hold when one key has a third of all rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_PARTS of all rows is hot, so there are fewer than HOT_PARTS hot keys whatever the data.
HOT_PARTS = 200


def hot_keys(df: DataFrame, key: str | list[str], parts: int = HOT_PARTS) -> list[tuple]:
    """The fewer than ``parts`` keys that hold more than 1/parts of the rows each (null keys aside). Under 100,000 rows none is named:
    that only spares a join its salt, the rows are the same."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    if total < 100_000:
        return []
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("__n") > total / parts).select(*keys).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", salts: int = 32, hot: list[tuple] | None = None) -> DataFrame:
    """``big`` join ``small`` on ``key``; rows of hot keys of ``big`` are spread over ``salts`` parts, and the rows of
    ``small`` with those keys repeated ``salts`` times. ``how``: inner, left, left_semi or left_anti."""
    keys = [key] if isinstance(key, str) else list(key)
    hot = hot_keys(big, keys) if hot is None else hot
    if not hot:
        return big.join(small, keys, how)

    def is_hot(df: DataFrame) -> Column:
        test = F.lit(False)
        for values in hot:
            one = F.lit(True)
            for k, v in zip(keys, values):
                one = one & (df[k] == F.lit(v))
            test = test | one
        return F.coalesce(test, F.lit(False))

    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in big.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")
    left = big.withColumn("__salt", F.when(is_hot(big), spread).otherwise(F.lit(0)))
    each = F.when(is_hot(small), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("__salt", F.explode(each))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
