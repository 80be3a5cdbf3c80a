"""JSON lines, keyed append-only stores, manifests and pair lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; torn or malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def checked_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, malformed lines): one permissive read, split by the text of what did not parse."""
    both = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).cache()
    return both.where("_corrupt_record IS NULL").drop("_corrupt_record"), both.where("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("line"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last record of each key wins."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def append_missing(df: DataFrame, path: str, keys: list[str], config: str | None = None) -> DataFrame:
    """Append to a Parquet store the rows whose keys it lacks, and give them back. With ``config``, a store written under
    another configuration is refused. Running it again appends nothing."""
    spark = df.sparkSession
    stored = _stored(spark, path)
    if config is not None:
        df = df.withColumn("config", F.lit(config))
        if stored is not None and not stored.where(F.col("config") != config).isEmpty():
            raise ValueError("the store was written under another configuration")
    new = df.dropDuplicates(keys)
    if stored is not None:
        new = new.join(stored.select(*keys).distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``updates`` in place of those with their key, and the new ones."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and fs.listStatus(p) else None


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, size) of every file in a folder."""
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, status) of files that are missing, new or changed against a manifest."""
    a, b = found.select("file", F.col("sha256").alias("now")), expected.select("file", F.col("sha256").alias("then"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "file", "full").select("file", status.alias("status")).where("status IS NOT NULL")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``provider url``; comments behind #, blank lines skipped: (provider, url)."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(line.alias("l")).where("l LIKE '% %'").select(F.split_part("l", F.lit(" "), F.lit(1)).alias("provider"), F.trim(F.regexp_replace("l", r"^\S+\s+", "")).alias("url"))


def canonical_key(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def json_schema(schema: T.StructType) -> dict:
    """The JSON form of a schema, for release beside the data."""
    return schema.jsonValue()
