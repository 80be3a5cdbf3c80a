"""Cutting lineage through the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset, as in local tests, a temporary
folder of this machine is used. What is written is compressed Parquet, so a lost executor costs a re-read and no
recomputation, and the table takes a fraction of an RDD checkpoint's disk.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a temporary one in local mode where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _LOCAL[sc.applicationId]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan after it starts at a scan. What an application wrote stands
    in one folder of its own, which can go when the application has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quernstone_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_quernstone_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
