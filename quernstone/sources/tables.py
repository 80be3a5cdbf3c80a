"""Scans of the Parquet tables of one data directory."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "guide_docs chunks questions result_cells gold_instances label_passes eval_items "
    "mix_targets cut_limits annotators"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
