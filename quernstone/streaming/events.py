"""Structured Streaming over files of events: windows, sessions and exactly-once replay.

Each function starts a stream with all input available now, writes it to a Parquet sink with a checkpoint in the shared folder and
gives back the finished table, so a query can be compared with its batch twin.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.materialize import shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A stream's source is a folder; a single file is read by a glob that only it meets."""
    return f"{sf_dir}/events.parque[t]"


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of what is there now and read what was written."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/quernstone-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed(events: DataFrame, window: Column, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums of each window and key; rows later than ``late`` behind the newest are dropped, and a window is given
    out once the newest row is that far past its end."""
    w = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", F.round("total", 4).alias("total"))


def _versions(spark: SparkSession, base: str) -> list[int]:
    """The whole versions of a table, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and whole(n))


def update_table(stream: DataFrame, merge: Callable[[DataFrame, DataFrame | None], DataFrame], base: str | None = None) -> DataFrame:
    """Fold every micro-batch into a table by ``merge(batch, table)``: what a run keeps by key.

    Batch n is merged with the newest whole version before n into version n, so a batch run again after a failure gives the same
    version, and a query started again on the same ``base`` goes on from what is on the disk.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/quernstone-table-{uuid.uuid4().hex}"

    def fold(batch: DataFrame, epoch: int) -> None:
        before = [v for v in _versions(spark, base) if v < epoch]
        old = spark.read.parquet(f"{base}/v={before[-1]}") if before else None
        merge(batch, old).write.mode("overwrite").parquet(f"{base}/v={epoch}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/v={_versions(spark, base)[-1]}")
