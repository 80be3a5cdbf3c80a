"""Event and call logs, resumable stores, validation, release of texts, splits, and streams."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions.urls import canonical_page
from quernstone.queries._registry import family
from quernstone.queries.evaluation import Q, cells
from quernstone.queries.pairs import gold
from quernstone.queries.text import DOCS, documents
from quernstone.sources.tables import table
from quernstone.streaming import events as E

QUERIES, ORACLES, query = family()


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type, user_id, count(*) AS n_calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, grouping(event_type, user_id)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())""")
def log_rollup(spark, sf_dir):
    """Calls and their total per step, per caller and in all."""
    return events(spark, sf_dir).groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.grouping_id().cast("bigint").alias("level"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 4) AS last_24h FROM events WHERE event_type <> 'error'""")
def rolling_24h(spark, sf_dir):
    """What a caller used in the 24 hours up to each call, errors aside."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-24 * 3600 * 1_000_000, 0)
    return events(spark, sf_dir).where("event_type <> 'error'").select("event_id", F.round(F.sum("value").over(w), 4).alias("last_24h"))


@query("""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n_events FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    """Runs of a caller's events with no gap over two hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > 7_200_000_000, F.lit(True)).cast("int")
    s = events(spark, sf_dir).withColumn("g", gap).withColumn("k", F.sum("g").over(w))
    return s.groupBy("user_id", "k").agg(F.unix_micros(F.min("ts")).alias("started_us"), F.unix_micros(F.max("ts")).alias("ended_us"), F.count(F.lit(1)).alias("n_events")).drop("k")


@query("""SELECT user_id, event_id, event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS since_us, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS errors_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_counts(spark, sf_dir):
    """After every event: time since the last one, and errors so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    return events(spark, sf_dir).select("user_id", "event_id", "event_type", F.coalesce(us - F.lag(us).over(w), F.lit(0)).alias("since_us"), F.sum((F.col("event_type") == "error").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("errors_so_far"))


@query("""SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS n_without FROM events GROUP BY event_type""")
def json_fields(spark, sf_dir):
    """A field of JSON text, where it parses."""
    k = F.expr("try_cast(get_json_object(props, '$.k') AS bigint)")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"), F.sum(F.get_json_object("props", "$.k").isNull().cast("bigint")).alias("n_without"))


REPLY = "struct<answers:array<struct<answer:string,evidence:array<string>,conditions:array<string>>>>"


@query(rf"""WITH c AS (SELECT cell_id, any_value(text) AS t FROM result_cells GROUP BY cell_id), j AS (SELECT cell_id, regexp_extract(t, '(?s)\{{.*\}}', 0) AS j FROM c WHERE t IS NOT NULL)
SELECT cell_id, ok AS parsed, CASE WHEN ok THEN least(5, coalesce(json_array_length(j, '$.answers'), 0)) ELSE 0 END::BIGINT AS n_answers, CASE WHEN ok THEN json_extract_string(j, '$.answers[0].answer') END AS first_answer FROM (SELECT *, json_valid(j) AND NOT regexp_matches(j, ',\s*[}}\]]') AS ok FROM j) WHERE j <> ''""")
def lenient_reply_parse(spark, sf_dir):
    """Replies read as JSON wherever they hold an object, at most five answers."""
    c = table(spark, sf_dir, "result_cells").dropDuplicates(["cell_id"]).where("text IS NOT NULL").select("cell_id", F.regexp_extract("text", r"(?s)\{.*\}", 0).alias("j")).where("j <> ''")
    p = F.from_json("j", REPLY, {"mode": "PERMISSIVE"})
    ok = F.expr("try_parse_json(j)").isNotNull()
    return c.select("cell_id", ok.alias("parsed"), F.when(ok, F.least(F.lit(5), F.coalesce(F.size(p["answers"]), F.lit(0)))).otherwise(0).cast("bigint").alias("n_answers"), F.when(ok, F.get(p["answers"], F.lit(0))["answer"]).alias("first_answer"))


@query("""WITH r AS (SELECT instance_id, annotator, seconds_spent AS s, row_number() OVER (PARTITION BY instance_id, annotator ORDER BY strptime(replace(labelled_at, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') DESC, received_at DESC, conflict_type DESC) AS r FROM label_passes)
SELECT annotator, count(*) AS n_items, round(sum(s), 3) AS seconds, round(min(s), 6) AS shortest, count(*) FILTER (s < 5) AS n_under_5s FROM r WHERE r = 1 GROUP BY annotator""")
def last_record_wins(spark, sf_dir):
    """Each annotator's store with the last record of an item only: items, time and haste."""
    w = Window.partitionBy("instance_id", "annotator").orderBy(F.desc(F.to_timestamp("labelled_at")), F.desc("received_at"), F.desc("conflict_type"))
    r = table(spark, sf_dir, "label_passes").withColumn("r", F.row_number().over(w)).where("r = 1")
    return r.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("seconds_spent"), 3).alias("seconds"), F.round(F.min("seconds_spent"), 6).alias("shortest"), F.sum((F.col("seconds_spent") < 5).cast("bigint")).alias("n_under_5s"))


@query(f"WITH {Q}, done AS (SELECT DISTINCT qid, system FROM c WHERE ok) SELECT s.system, count(*) AS n_todo FROM q CROSS JOIN (SELECT DISTINCT system FROM c) s WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.qid = q.qid AND d.system = s.system) GROUP BY s.system")
def remaining_work(spark, sf_dir):
    """Questions a system still owes a parsed reply: an anti-join on the finished ones."""
    q = table(spark, sf_dir, "questions").select("qid").distinct()
    c = cells(spark, sf_dir).select("qid", "system", "ok")
    todo = q.crossJoin(F.broadcast(c.select("system").distinct()))  # a row for each system
    return todo.join(c.where("ok").select("qid", "system").distinct(), ["qid", "system"], "left_anti").groupBy("system").agg(F.count(F.lit(1)).alias("n_todo"))


@query("""WITH b AS (SELECT qid, any_value(doc) AS doc, any_value(lower(trim(split))) AS split FROM questions GROUP BY qid) SELECT doc, count(*) AS n_questions, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT split)), ' ') AS splits FROM b WHERE split IS NOT NULL GROUP BY doc HAVING count(DISTINCT split) > 1""")
def leaking_documents(spark, sf_dir):
    """Documents with questions in more than one split."""
    q = table(spark, sf_dir, "questions").dropDuplicates(["qid"]).select("doc", F.lower(F.trim("split")).alias("split")).where("split IS NOT NULL")
    return q.groupBy("doc").agg(F.count(F.lit(1)).alias("n_questions"), F.count_distinct("split").alias("n_splits"), F.array_join(F.array_sort(F.collect_set("split")), " ").alias("splits")).where("n_splits > 1")


@query(r"""WITH g AS (SELECT instance_id, any_value(passages) AS p, any_value(gold_conflict_type) AS t, any_value(gold_scope_relation) AS s, any_value(gold_branches) AS b, any_value(contract_version) AS v FROM gold_instances GROUP BY 1), x AS (SELECT instance_id, unnest([
 CASE WHEN len(list_distinct(list_transform(p, lambda z: z.id))) < len(p) THEN 'repeated_passage_id' END, CASE WHEN t = 'conditional' AND s IS NULL THEN 'no_relation' END, CASE WHEN t <> 'conditional' AND s IS NOT NULL THEN 'relation_without_conflict' END,
 CASE WHEN len(list_filter(b, lambda z: z.supporting_passage IS NOT NULL AND NOT list_contains(list_transform(p, lambda y: y.id), z.supporting_passage))) > 0 THEN 'unknown_support' END, CASE WHEN len(list_filter(b, lambda z: z.applicability.is_default)) > 1 THEN 'two_defaults' END, CASE WHEN split_part(v, '.', 1) <> '1' THEN 'version' END]) AS rule FROM g)
SELECT rule, count(*) AS n, min(instance_id) AS first_instance FROM x WHERE rule IS NOT NULL GROUP BY rule""")
def record_validation(spark, sf_dir):
    """Rules that records break, gathered from one array of violations a row."""
    ids = F.transform("passages", lambda z: z["id"])
    b = F.col("gold_branches")
    rules = F.array(
        F.when(F.size(F.array_distinct(ids)) < F.size("passages"), "repeated_passage_id"), F.when((F.col("gold_conflict_type") == "conditional") & F.col("gold_scope_relation").isNull(), "no_relation"),
        F.when((F.col("gold_conflict_type") != "conditional") & F.col("gold_scope_relation").isNotNull(), "relation_without_conflict"),
        F.when(F.exists(b, lambda z: z["supporting_passage"].isNotNull() & ~F.array_contains(ids, z["supporting_passage"])), "unknown_support"),
        F.when(F.size(F.filter(b, lambda z: F.coalesce(z["applicability"]["is_default"], F.lit(False)))) > 1, "two_defaults"), F.when(F.split_part("contract_version", F.lit("."), F.lit(1)) != "1", "version"),
    )
    v = gold(spark, sf_dir).select("instance_id", F.explode(rules).alias("rule")).where("rule IS NOT NULL")
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("first_instance"))


@query(rf"""WITH {DOCS} SELECT doc_id, CASE WHEN source_type = 'government_guidance' THEN 'open' ELSE 'redact' END AS policy, sha256(coalesce(text, '')) AS text_sha, CASE WHEN source_type = 'government_guidance' THEN text ELSE '[redacted ' || substr(sha256(coalesce(text, '')), 1, 12) || ']' END AS released FROM docs""")
def release_redact(spark, sf_dir):
    """Texts as released: open ones whole, others as a placeholder with the hash by which they are put back."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    is_open = F.coalesce(F.col("source_type") == "government_guidance", F.lit(False))
    return documents(spark, sf_dir).select("doc_id", F.when(is_open, "open").otherwise("redact").alias("policy"), sha.alias("text_sha"), F.when(is_open, F.col("text")).otherwise(F.concat(F.lit("[redacted "), F.substring(sha, 1, 12), F.lit("]"))).alias("released"))


@query(r"""WITH u AS (SELECT DISTINCT doc, url, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '#.*$', '') AS u FROM guide_docs WHERE trim(url) <> ''),
c AS (SELECT doc, url, regexp_replace(regexp_replace(split_part(u, '?', 1), '^www\.', ''), ':(80|443)(/|$)', '\2') AS p, list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_\w+|ref|referrer|source|print|fbclid|gclid|share|session|sid|amp)(=.*)?|page=1|p=1|start=0|offset=0'))) AS args FROM u),
g AS (SELECT doc, url, regexp_replace(regexp_replace(p, '/+', '/', 'g'), '/(index\.html?)?$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS page FROM c) SELECT page, count(DISTINCT doc) AS n_docs, count(DISTINCT url) AS n_spellings FROM g GROUP BY page HAVING count(DISTINCT doc) > 1""")
def pages_under_two_ids(spark, sf_dir):
    """Pages that stand under more than one document id."""
    g = table(spark, sf_dir, "guide_docs").select("doc", canonical_page(F.col("url")).alias("page"), "url")
    return g.groupBy("page").agg(F.count_distinct("doc").alias("n_docs"), F.count_distinct("url").alias("n_spellings")).where("n_docs > 1")


def _hashed(seed, c):
    return F.md5(F.concat_ws("|", F.lit(seed), c.cast("string")))


@query("""WITH q AS (SELECT DISTINCT qid, not_answerable AS na FROM questions), r AS (SELECT qid, na, row_number() OVER (PARTITION BY na ORDER BY md5('7|' || qid), qid) AS r FROM q) SELECT qid, na AS not_answerable, r AS place FROM r WHERE r <= 50""")
def stratified_sample(spark, sf_dir):
    """Fifty questions of each stratum in a seeded order: sampling is what this operator is for."""
    w = Window.partitionBy("not_answerable").orderBy(_hashed("7", F.col("qid")), "qid")
    q = table(spark, sf_dir, "questions").select("qid", "not_answerable").distinct()
    return q.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 50")


@query("""WITH d AS (SELECT DISTINCT doc FROM questions WHERE doc IS NOT NULL), f AS (SELECT doc, ('0x' || substr(md5('f|' || doc), 1, 8))::BIGINT % 5 AS fold FROM d) SELECT fold, count(DISTINCT doc) AS n_docs, count(DISTINCT qid) AS n_questions FROM questions JOIN f USING (doc) GROUP BY fold""")
def document_folds(spark, sf_dir):
    """Five folds by document, each document in one: a hash of the document, so no order is needed."""
    fold = F.conv(F.substring(_hashed("f", F.col("doc")), 1, 8), 16, 10).cast("bigint") % 5
    q = table(spark, sf_dir, "questions").where("doc IS NOT NULL").withColumn("fold", fold)
    return q.groupBy("fold").agg(F.count_distinct("doc").alias("n_docs"), F.count_distinct("qid").alias("n_questions"))


@query("""SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    """Hourly counts of a stream, each micro-batch folded into the table: complete at any time, the batch twin is the oracle."""
    t = E.update_table(s_batches(spark, sf_dir), _merge_hours)
    return t.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


def s_batches(spark, sf_dir):
    return E.read_events(spark, sf_dir).select("event_type", F.date_trunc("hour", "ts").alias("start"), "value")


def _merge_hours(batch, old):
    new = batch.groupBy("event_type", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    if old is None:
        return new
    return old.unionByName(new).groupBy("event_type", "start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("""SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, epoch_us(max(ts)) AS newest_us FROM events GROUP BY event_type""")
def stream_dedupe(spark, sf_dir):
    """Events delivered twice counted once: the stream is read with itself and deduplicated by key within the watermark."""
    e = E.read_events(spark, sf_dir)
    twice = e.unionByName(E.read_events(spark, sf_dir)).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    d = E.finished(twice)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.unix_micros(F.max("ts")).alias("newest_us"))


CLOSED = "WHERE window_end_us <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)"


@query(f"""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - o * 3600000000 AS window_start_us, event_type, value FROM events, (SELECT unnest([0, 1]) AS o)), g AS (SELECT window_start_us, window_start_us + 7200000000 AS window_end_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL) SELECT * FROM g {CLOSED}""")
def stream_sliding(spark, sf_dir):
    """Windows of two hours each hour, as a stream gives them once the watermark of an hour has passed their end."""
    w = E.finished(E.windowed(E.read_events(spark, sf_dir), F.window("ts", "2 hours", "1 hour"), "1 hour", ["event_type"]))
    return w.select(F.unix_micros("window_start").alias("window_start_us"), F.unix_micros("window_end").alias("window_end_us"), "event_type", "n", "total")


@query(f"""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
x AS (SELECT user_id, epoch_us(min(ts)) AS window_start_us, epoch_us(max(ts)) + 7200000000 AS window_end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k) SELECT * FROM x {CLOSED}""")
def stream_sessions(spark, sf_dir):
    """Sessions with gaps under two hours, as a stream gives them once they are closed."""
    w = E.finished(E.windowed(E.read_events(spark, sf_dir), F.session_window("ts", "2 hours"), "1 hour", ["user_id"]))
    return w.select(F.unix_micros("window_start").alias("window_start_us"), F.unix_micros("window_end").alias("window_end_us"), "user_id", "n", "total")
