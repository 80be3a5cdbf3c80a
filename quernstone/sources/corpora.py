"""Corpora of passages, stored rankings and scores, review logs, caches, releases: reading, keeping and writing them."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize
from quernstone.sources.stores import append_missing, latest, manifest, mismatches, read_json_lines, upsert

PASSAGE = "id string, text string, source_type string, date string, source_url string, document_id string"


def unique(df: DataFrame, key: str = "id") -> DataFrame:
    """``df``, or an error if a key stands twice or is missing."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).unionByName(df.where(F.col(key).isNull()).select(key, F.lit(1).cast("bigint").alias("n"))).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][key]!r} is missing or stands more than once")
    return df


def corpus_from_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Passages of a JSON-lines file; ids must be unique."""
    return unique(read_json_lines(spark, path, PASSAGE))


def corpus_from_records(records: DataFrame, key: str = "instance_id") -> DataFrame:
    """Passages of records (key, passages) under ids ``record::passage``; of one id the first passage of its record stands."""
    p = records.select(key, F.posexplode("passages").alias("pos", "x"))
    first = p.groupBy(F.concat_ws("::", F.col(key), F.col("x.id")).alias("id")).agg(F.min_by("x", "pos").alias("x"))
    return first.select("id", F.col("x.text").alias("text"), F.col("x.source_type").alias("source_type"), F.col("x.date").alias("date"), F.col("x.source_url").alias("source_url"), F.col("x.document_id").alias("document_id"))


def corpus_from_texts(spark: SparkSession, texts: list[str], prefix: str = "p") -> DataFrame:
    """Texts given in place, as passages p0, p1 and so on."""
    return spark.createDataFrame([(f"{prefix}{i}", t) for i, t in enumerate(texts)], "id string, text string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line): lines that are not blank with their place, from 0. Each partition of the scan counts its own, and is moved by the
    numbers of those before."""
    d = spark.read.text(path).where(F.trim("value") != "").withColumn("m", F.monotonically_increasing_id())
    d = materialize(d.select(F.col("value").alias("line"), F.expr("shiftright(m, 33)").alias("p"), F.expr("m & 8589934591").alias("r")), "lines")
    n = d.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition of the scan
    before = n.select("p", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d.join(before, "p").select((F.col("r") + F.col("before")).alias("i"), "line")


def questions_with_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of (question, documents[]) to questions (qid, question) and documents (doc_id, qid, text, type): question i of the file
    is r<i> and its document j r<i>d<j>. Blank lines are skipped and not counted."""
    schema = "question string, gold_answers array<string>, wrong_answers array<string>, documents array<struct<text string, type string>>"
    raw = numbered_lines(spark, path)
    q = raw.select(F.concat(F.lit("r"), F.col("i").cast("string")).alias("qid"), F.from_json("line", schema).alias("x"))
    d = q.select("qid", F.posexplode("x.documents").alias("j", "d")).select(F.concat("qid", F.lit("d"), F.col("j").cast("string")).alias("doc_id"), "qid", "d.text", "d.type")
    return q.select("qid", "x.question", "x.gold_answers", "x.wrong_answers"), d


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def keep_rankings(questions: DataFrame, rank, path: str, config: str, refresh: bool = False) -> DataFrame:
    """Rankings (qid, rank, chunk_id) of ``questions`` from a store at ``path``: only questions it lacks are ranked, by ``rank(todo)``, and
    appended; ``refresh`` ranks all anew. A store of another configuration is refused."""
    spark = questions.sparkSession
    if refresh:
        rank(questions).withColumn("config", F.lit(config)).write.mode("overwrite").parquet(path)
    else:
        have = load_rankings(spark, path)
        todo = questions if have is None else questions.join(have.select("qid").distinct(), "qid", "left_anti")
        append_missing(rank(todo), path, ["qid", "rank"], config)
    return load_rankings(spark, path)


def load_rankings(spark: SparkSession, path: str) -> DataFrame | None:
    from quernstone.sources.stores import _stored

    return _stored(spark, path)


def reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A log of decisions (kind, annotator, item, decision, seconds, at) to the decision that stands of each item, and hours by kind
    and annotator over all lines."""
    log = read_json_lines(spark, path, "kind string, annotator string, item string, decision string, seconds double, at string").where("item IS NOT NULL")
    hours = log.groupBy("kind", "annotator").agg((F.sum("seconds") / 3600).alias("hours"), F.count(F.lit(1)).alias("n_lines"))
    return latest(log, ["kind", "annotator", "item"], [F.desc("at"), F.desc("decision")]), hours


def sealed(log: DataFrame, seals: DataFrame) -> DataFrame:
    """Lines of a log (annotator, at) written after the annotator's file was sealed (annotator, sealed_at): there should be none."""
    return log.join(seals, "annotator").where(F.col("at") > F.col("sealed_at"))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A request cache (key, model, response, at) with entries put in, replacing those of their key."""
    return upsert(cache, latest(new, ["key"], [F.desc("at")]), "key")


def cache_clear(cache: DataFrame, model: str | None = None) -> DataFrame:
    return cache.limit(0) if model is None else cache.where(F.col("model") != model)


def events_after(events: DataFrame, run: str, after: int) -> DataFrame:
    """Events (run_id, seq) of a run behind a cursor, in order."""
    return events.where((F.col("run_id") == run) & (F.col("seq") > after)).orderBy("seq")


def stage_durations(events: DataFrame) -> DataFrame:
    """Events (run_id, seq, stage, at) to the seconds of each stage: from its first event to the first of what comes next, null for
    the last one."""
    first = events.groupBy("run_id", "stage").agg(F.min("seq").alias("seq"), F.min_by("at", "seq").alias("at"))
    w = Window.partitionBy("run_id").orderBy("seq")  # a run has few stages
    return first.select("run_id", "stage", (F.unix_micros(F.lead("at").over(w)) - F.unix_micros("at")).alias("micros")).select("run_id", "stage", (F.col("micros") / 1e6).alias("seconds"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """(provider, url) as lines ``provider url``."""
    pairs.select(F.concat_ws(" ", "provider", "url").alias("value")).write.mode("overwrite").text(path)


def existing_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs (a < b) of addresses that one provider has."""
    a, b = pairs.select("provider", F.col("url").alias("a")), pairs.select("provider", F.col("url").alias("b"))
    return a.join(b, "provider").where("a < b").select("a", "b").distinct()


def write_release(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as JSON lines in a folder of its own, then a manifest with the hash of each file, which is also returned."""
    spark = next(iter(tables.values())).sparkSession
    every = None
    for name, df in tables.items():
        write_json_lines(df, f"{folder}/{name}")
        own = manifest(spark, f"{folder}/{name}/*.json").withColumn("table", F.lit(name))
        every = own if every is None else every.unionByName(own)
    every.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema("file string, sha256 string, size bigint, `table` string").json(f"{folder}/manifest")


def broken_files(spark: SparkSession, folder: str) -> DataFrame:
    """(table, file, status) of files of a release that differ from its manifest."""
    then = spark.read.schema("file string, sha256 string, size bigint, `table` string").json(f"{folder}/manifest")
    out = None
    for name in sorted(r["table"] for r in then.select("table").distinct().collect()):  # a row for each table
        own = mismatches(manifest(spark, f"{folder}/{name}/*.json"), then.where(F.col("table") == name)).select(F.lit(name).alias("table"), "file", "status")
        out = own if out is None else out.unionByName(own)
    return out


def short_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows as compact JSON under short keys, for a browser: (json)."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(k) for c, k in names.items()])).alias("json"))


def json_contract(df: DataFrame) -> str:
    """The JSON form of a table's schema."""
    return json.dumps(df.schema.jsonValue(), sort_keys=True)
