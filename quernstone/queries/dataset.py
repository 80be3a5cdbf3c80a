"""Building and checking data sets: hard negatives, mining, pair detection and its intervals, where snippets stand."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import inference as I
from quernstone.operators import metrics as M
from quernstone.operators import retrieval as R
from quernstone.plans.materialize import materialize
from quernstone.queries._registry import family
from quernstone.queries.composition import GI, instances, query_records
from quernstone.queries.pairs import CONTENT, CUES, NLI, _ruled, mine_rule_exceptions
from quernstone.queries.retrieval import BM25, _items
from quernstone.queries.text import ELEMENTS, documents, elements, pages

QUERIES, ORACLES, query = family()

TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH {BM25}, it AS (SELECT DISTINCT item_id AS qid, text AS q FROM eval_items), r AS (SELECT bm.qid, bm.doc_id, bm.rank, coalesce(docs.source, 'none') AS source, {TOK.format('it.q')} AS tq, {TOK.format('docs.text')} AS td FROM bm JOIN docs USING (doc_id) JOIN it USING (qid) WHERE bm.rank <= 40),
n AS (SELECT qid, doc_id, rank, source FROM r WHERE len(list_intersect(tq, td)) / len(list_distinct(list_concat(tq, td))) < 0.6), s AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) > 2 AS over FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY over, rank) AS place FROM s)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY md5(qid::VARCHAR || '|' || doc_id::VARCHAR), doc_id) - 1 AS position FROM p WHERE place <= 6""")
def hard_negatives(spark, sf_dir):
    """Six documents that rank high for an item without being its copies: two of a source at most while others are to be had, in the
    order of a hash."""
    d = documents(spark, sf_dir).select("doc_id", "text", "source")
    r = materialize(R.bm25(_items(spark, sf_dir), d, 40), "ranked")
    j = r.join(d, "doc_id").join(_items(spark, sf_dir).withColumnRenamed("text", "q"), "qid")
    j = j.where(T.jaccard(F.array_distinct(T.tokens(F.col("q"))), F.array_distinct(T.tokens(F.col("text")))) < 0.6).select("qid", "doc_id", "rank", F.coalesce("source", F.lit("none")).alias("source"))
    j = j.withColumn("over", F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank")) > 2)
    p = j.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("over", "rank"))).where("place <= 6")
    h = F.md5(F.concat_ws("|", F.col("qid").cast("string"), F.col("doc_id").cast("string")))
    return p.select("qid", "doc_id", (F.row_number().over(Window.partitionBy("qid").orderBy(h, "doc_id")) - 1).cast("bigint").alias("position"))


@query(f"""WITH {ELEMENTS}, s AS (SELECT doc, pos, {CUES('txt', T.EXCEPTION_CUES)} > 0 AS exc, regexp_matches(lower(txt), '\\b(must|pays|can|may)\\b') AS rule, {CONTENT.format('txt')} AS t FROM el WHERE length(txt) >= 30),
p AS (SELECT r.doc, r.pos AS rule_pos, round(len(list_intersect(r.t, e.t)) / len(list_distinct(list_concat(r.t, e.t))), 9) AS overlap, row_number() OVER (PARTITION BY r.doc, r.pos ORDER BY round(len(list_intersect(r.t, e.t)) / len(list_distinct(list_concat(r.t, e.t))), 9) DESC, e.pos) AS rank FROM s r JOIN s e ON r.doc = e.doc AND r.pos <> e.pos AND r.rule AND NOT r.exc AND e.exc)
SELECT g.t AS threshold, count(*) AS n_pairs, count(DISTINCT doc) AS n_pages FROM p, (SELECT round(0.18 + unnest(range(5)) * 0.02, 2)::DOUBLE AS t) g WHERE rank <= 2 AND overlap >= greatest(0.18, g.t) GROUP BY g.t""")
def mining_sensitivity(spark, sf_dir):
    """Pairs of a rule and its exceptions that are left as the overlap asked for rises."""
    m = mine_rule_exceptions(spark, sf_dir).withColumn("t", F.explode(F.array(*[F.lit(round(0.18 + i * 0.02, 2)) for i in range(5)])))
    return m.where("overlap >= t").groupBy(F.col("t").alias("threshold")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("doc").alias("n_pages"))


GOLDP = f"{GI}, gp AS (SELECT instance_id, construction, ctype, list_sort(list_filter(list_transform(ps, lambda p: p.id), lambda i: NOT starts_with(i, 'n'))) AS ids FROM gi), pg AS (SELECT instance_id, construction, ctype, ids[1] AS di, ids[2] AS dj, ctype <> 'no_conflict' AS y FROM gp WHERE len(ids) >= 2)"


def labelled_pairs(spark, sf_dir) -> DataFrame:
    """The pair of each instance that its label describes, with the rule score of that pair."""
    g = query_records(spark, sf_dir).where("doc_j IS NOT NULL").join(instances(spark, sf_dir).select("instance_id", "construction"), "instance_id")
    return g.join(_ruled(spark, sf_dir).select("instance_id", "doc_i", "doc_j", "score"), ["instance_id", "doc_i", "doc_j"], "left")


@query(f"""WITH {NLI}, {GOLDP}, x AS (SELECT pg.construction, y, coalesce(rs.score >= 0.5, false) AS hit FROM pg LEFT JOIN rs ON rs.instance_id = pg.instance_id AND rs.doc_i = di AND rs.doc_j = dj) SELECT construction, count(*) FILTER (y AND hit) AS tp, count(*) FILTER (NOT y AND hit) AS fp, count(*) FILTER (y AND NOT hit) AS fn, count(*) FILTER (NOT y AND NOT hit) AS tn FROM x GROUP BY construction""")
def pair_detection(spark, sf_dir):
    """Labelled pairs found by the rule score; a pair that was not scored counts as not found."""
    x = labelled_pairs(spark, sf_dir)
    y, hit = F.col("is_conflict"), F.coalesce(F.col("score") >= 0.5, F.lit(False))
    return x.groupBy("construction").agg(M.count_if(y & hit).alias("tp"), M.count_if(~y & hit).alias("fp"), M.count_if(y & ~hit).alias("fn"), M.count_if(~y & ~hit).alias("tn"))


@query(f"""WITH {NLI}, {GOLDP}, x AS (SELECT pg.instance_id, y, coalesce(rs.score >= 0.5, false) AS hit FROM pg LEFT JOIN rs ON rs.instance_id = pg.instance_id AND rs.doc_i = di AND rs.doc_j = dj),
m AS (SELECT 'precision' AS measure, instance_id AS unit, (y AND hit)::INT::DOUBLE AS s, hit::INT AS n FROM x UNION ALL SELECT 'recall', instance_id, (y AND hit)::INT, y::INT FROM x UNION ALL SELECT 'f1', instance_id, 2 * (y AND hit)::INT, hit::INT + y::INT FROM x),
uu AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY measure) AS k FROM m), pk AS (SELECT measure, d AS draw, ('0x' || substr(md5('b|' || d || '|' || i), 1, 8))::BIGINT % k AS i FROM uu, (SELECT unnest(range(200)) AS d)),
dr AS (SELECT measure, draw, sum(s) / nullif(sum(n), 0) AS mean FROM pk JOIN uu USING (measure, i) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY mean) - 1 AS r, count(*) OVER (PARTITION BY measure) AS b FROM dr WHERE mean IS NOT NULL)
SELECT measure, round(max(CASE WHEN r = least(floor(0.025 * b), b - 1) THEN mean END), 6) AS low, round(max(CASE WHEN r = least(floor(0.975 * b), b - 1) THEN mean END), 6) AS high, max(b) AS n_draws FROM o GROUP BY measure""")
def detection_intervals(spark, sf_dir):
    """Percentile intervals of precision, recall and F1, instances drawn with replacement: each is a ratio of two sums."""
    x = labelled_pairs(spark, sf_dir)
    y, hit = F.col("is_conflict").cast("int"), F.coalesce(F.col("score") >= 0.5, F.lit(False)).cast("int")
    m = F.array(*[F.struct(F.lit(n).alias("measure"), s.cast("double").alias("s"), k.alias("n")) for n, s, k in (("precision", y * hit, hit), ("recall", y * hit, y), ("f1", 2 * y * hit, y + hit))])
    units = x.select(F.col("instance_id").alias("unit"), F.explode(m).alias("m")).select("unit", "m.*")
    d = I.cluster_bootstrap(units, ["measure"]).where("mean IS NOT NULL")
    return I.percentile_interval(d, ["measure"], "mean")


@query(f"""WITH {ELEMENTS}, sn AS (SELECT DISTINCT doc AS home, txt AS s FROM el WHERE length(txt) BETWEEN 60 AND 120), k AS (SELECT doc, txt, substr(txt, 1, 60) AS h FROM el WHERE length(txt) >= 60) SELECT home, md5(s) AS snippet_md5, count(DISTINCT k.doc) AS n_pages, min(k.doc) AS first_page FROM sn JOIN k ON k.h = substr(s, 1, 60) GROUP BY home, s""")
def snippet_pages(spark, sf_dir):
    """Pages on which an element begins with the first sixty letters of a short element: where a snippet may come from. The letters are
    the key of the join; sixty are what the rule compares. Pages are counted once for all snippets that begin alike."""
    long = F.filter(F.transform("elements", T.text_of), lambda x: F.length(x) >= 60)
    e = materialize(pages(spark, sf_dir).select("doc", F.array_distinct(long).alias("t")), "texts")  # read twice, parsed once
    begins = F.array_distinct(F.transform("t", lambda x: F.substring(x, 1, 60)))
    k = e.select("doc", F.explode(begins).alias("h")).groupBy("h").agg(F.count("doc").alias("n_pages"), F.min("doc").alias("first_page"))
    s = e.select(F.col("doc").alias("home"), F.explode(F.filter("t", lambda x: F.length(x) <= 120)).alias("s"))
    return s.select("home", F.md5("s").alias("snippet_md5"), F.substring("s", 1, 60).alias("h")).join(k, "h").drop("h")
