"""Rankings over documents, chunks and vectors, and what is made of them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import retrieval as R
from quernstone.plans.materialize import materialize
from quernstone.queries._registry import family
from quernstone.queries.text import DOCS, documents
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("qid"), "text").distinct()


BM25 = rf"""{DOCS}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM docs WHERE text IS NOT NULL),
dl AS (SELECT doc_id, len(t) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT item_id, text FROM eval_items)) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)"""
OVERLAP = rf"""dt AS (SELECT doc_id, list_distinct(t) AS t FROM d), qt AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM (SELECT DISTINCT item_id, text FROM eval_items)),
ov AS (SELECT qid, doc_id, round(len(list_intersect(qt.t, dt.t))::DOUBLE / len(list_distinct(list_concat(qt.t, dt.t))), 9) AS score FROM qt, dt),
lx AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ov)"""
GOLD = """gold AS (SELECT DISTINCT item_id AS qid, doc_id FROM (SELECT DISTINCT item_id, text AS it FROM eval_items), docs WHERE contains(text, it))"""


def _gold(spark, sf_dir) -> DataFrame:
    """Documents that hold an item word for word; the items are a stated query set."""
    return R.holding(_items(spark, sf_dir), documents(spark, sf_dir))


@query(f"WITH {BM25} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 8")
def bm25_top8(spark, sf_dir):
    """The eight best documents for each evaluation item."""
    return R.bm25(_items(spark, sf_dir), documents(spark, sf_dir), 8).withColumn("score", F.round("score", 6))


@query(f"""WITH {BM25}, {GOLD}, f AS (SELECT g.qid, g.doc_id, rank FROM gold g LEFT JOIN (SELECT * FROM bm WHERE rank <= 50) USING (qid, doc_id)),
per AS (SELECT qid, k, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END) AS recall, min(rank) AS first FROM f, (SELECT unnest([3, 5, 8, 12, 20, 50])::BIGINT AS k) GROUP BY qid, k)
SELECT k, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0 END), 6) AS hit_share, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0 END), 6) AS mrr FROM per GROUP BY k""")
def bm25_recall_at_k(spark, sf_dir):
    """Recall, hits and reciprocal rank of documents that hold the item word for word."""
    return R.recall_at(R.bm25(_items(spark, sf_dir), documents(spark, sf_dir), 50), _gold(spark, sf_dir), [3, 5, 8, 12, 20, 50])


VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS qid, b.vec_id AS vec_id, a.label AS ql, b.label AS vl, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) AS cosine FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM p)"""


def _knn(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings")
    return R.knn(e.where("vec_id % 100 = 0"), e, k)  # the stated query set: ids divisible by 100, against all rows


@query(f"WITH {VECTORS} SELECT qid, vec_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 5")
def knn_top5(spark, sf_dir):
    """The five nearest vectors by cosine."""
    return _knn(spark, sf_dir, 5).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {VECTORS} SELECT ql::BIGINT AS label, count(*) AS n_neighbours, round(avg(CASE WHEN ql = vl THEN 1.0 ELSE 0 END), 6) AS same_label FROM r WHERE rank <= 10 GROUP BY ql")
def knn_label_accuracy(spark, sf_dir):
    """How often neighbours share the label."""
    lab = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    n = _knn(spark, sf_dir, 10).join(lab.withColumnRenamed("label", "vl"), "vec_id").join(lab.withColumnRenamed("vec_id", "qid"), "qid")
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n_neighbours"), F.round(F.avg((F.col("label") == F.col("vl")).cast("double")), 6).alias("same_label"))


@query(f"""WITH {BM25}, {OVERLAP}, u AS (SELECT qid, doc_id, rank, 'bm25' AS b FROM bm WHERE rank <= 32 UNION ALL SELECT qid, doc_id, rank, 'overlap' FROM lx WHERE rank <= 32),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(CASE WHEN b = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN b = 'overlap' THEN rank END) AS overlap_rank FROM u GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) SELECT qid, doc_id, round(score, 6) AS score, bm25_rank, overlap_rank, rank FROM r WHERE rank <= 8""")
def rrf_top8(spark, sf_dir):
    """BM25 and token overlap fused by reciprocal rank; pools of four times the depth."""
    pool = max(4 * 8, 20)
    fused = R.reciprocal_rank_fusion({"bm25": R.bm25(_items(spark, sf_dir), documents(spark, sf_dir), pool), "overlap": R.token_overlap(_items(spark, sf_dir), documents(spark, sf_dir), pool)}, 8)
    return fused.withColumn("score", F.round("score", 6))


@query(f"""WITH {BM25}, r AS (SELECT bm.*, source FROM bm JOIN docs USING (doc_id) WHERE rank <= 50),
top AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS sr FROM r GROUP BY qid, source),
h AS (SELECT qid, doc_id, rank AS flat_rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM r JOIN top USING (qid, source) WHERE sr <= 2) SELECT * FROM h WHERE rank <= 8""")
def hierarchical_top8(spark, sf_dir):
    """Two best groups first, then the best documents inside them."""
    r = R.bm25(_items(spark, sf_dir), documents(spark, sf_dir), 50).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id").where("source IS NOT NULL")
    r = materialize(r.select("qid", "doc_id", "source", F.col("rank").alias("flat_rank")), "ranked")
    groups = R.top_k(r.groupBy("qid", "source").agg(F.min("flat_rank").alias("best")), "qid", [F.asc("best")], 2).select("qid", "source")
    return R.top_k(r.join(groups, ["qid", "source"], "left_semi").select("qid", "doc_id", "flat_rank"), "qid", [F.asc("flat_rank")], 8)


CELLS = """cells AS (SELECT cell_id, any_value(qid) AS qid, any_value(chunks) AS chunks, any_value(system) AS system, any_value(answers) AS answers, any_value(ok) AS ok FROM result_cells GROUP BY cell_id),
c AS (SELECT DISTINCT chunk_id, doc, idx, el_start, el_end, strategy FROM chunks),
shown AS (SELECT cell_id, chunk_id, min(rank) AS rank FROM (SELECT cell_id, unnest(chunks) AS chunk_id, unnest(range(len(chunks))) + 1 AS rank FROM cells) GROUP BY cell_id, chunk_id)"""


def _shown(spark, sf_dir):
    """(cell_id, chunk_id, rank, doc, idx, el_start, el_end, strategy) of the chunks each cell was shown."""
    r = table(spark, sf_dir, "result_cells").dropDuplicates(["cell_id"]).select("cell_id", F.posexplode("chunks").alias("p", "chunk_id"))
    r = r.groupBy("cell_id", "chunk_id").agg((F.min("p") + 1).cast("bigint").alias("rank"))
    c = table(spark, sf_dir, "chunks").select("chunk_id", "doc", "idx", "el_start", "el_end", "strategy").distinct()
    return r.join(c, "chunk_id")


@query(f"""WITH {CELLS}, k AS (SELECT unnest([1, 3, 5, 8])::BIGINT AS k) SELECT system, k, count(*) AS n_shown, count(DISTINCT doc) AS n_pages, sum(el_end - el_start)::BIGINT AS n_elements
FROM shown JOIN cells USING (cell_id) JOIN c USING (chunk_id), k WHERE rank <= k GROUP BY system, k""")
def topk_ladder(spark, sf_dir):
    """What each system shows at a ladder of depths."""
    cells = table(spark, sf_dir, "result_cells").dropDuplicates(["cell_id"]).select("cell_id", "system")
    s = _shown(spark, sf_dir).join(cells, "cell_id").withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 3, 5, 8)]))).where("rank <= k")
    return s.groupBy("system", "k").agg(F.count(F.lit(1)).alias("n_shown"), F.count_distinct("doc").alias("n_pages"), F.sum(F.col("el_end") - F.col("el_start")).cast("bigint").alias("n_elements"))


@query(f"""WITH {CELLS}, s AS (SELECT cell_id, rank, chunk_id, doc, idx, strategy FROM shown JOIN c USING (chunk_id)),
cand AS (SELECT cell_id, chunk_id, rank * 3 AS pri FROM s UNION ALL SELECT s.cell_id, n.chunk_id, s.rank * 3 + CASE WHEN n.idx > s.idx THEN 1 ELSE 2 END + 1000 FROM s JOIN c n ON n.doc = s.doc AND n.strategy = s.strategy AND abs(n.idx - s.idx) = 1),
d AS (SELECT cell_id, chunk_id, min(pri) AS pri FROM cand GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY pri, chunk_id) AS rank FROM d)
SELECT cell_id, chunk_id, rank, pri > 1000 AS added FROM r WHERE rank <= 8""")
def adjacent_completion(spark, sf_dir):
    """The chunks shown, then the next and the previous chunk of each, to eight in all."""
    s = _shown(spark, sf_dir)
    c = table(spark, sf_dir, "chunks").select("chunk_id", "doc", "idx", "strategy").distinct()
    steps = s.select("cell_id", "rank", "doc", "strategy", F.explode(F.array(F.struct((F.col("idx") + 1).alias("idx"), F.lit(1).alias("side")), F.struct((F.col("idx") - 1).alias("idx"), F.lit(2).alias("side")))).alias("n"))
    near = steps.select("cell_id", "doc", "strategy", F.col("n.idx").alias("idx"), (F.col("rank") * 3 + F.col("n.side") + 1000).alias("pri")).join(c, ["doc", "strategy", "idx"]).select("cell_id", "chunk_id", "pri")
    best = s.select("cell_id", "chunk_id", (F.col("rank") * 3).alias("pri")).unionByName(near).groupBy("cell_id", "chunk_id").agg(F.min("pri").alias("pri"))
    return R.top_k(best, "cell_id", [F.asc("pri"), F.asc("chunk_id")], 8).select("cell_id", "chunk_id", "rank", (F.col("pri") > 1000).alias("added"))


@query(f"""WITH {CELLS}, e AS (SELECT DISTINCT cell_id, doc, pos FROM (SELECT cell_id, doc, unnest(range(greatest(el_start - 2, 0), el_end + 2)) AS pos FROM shown JOIN c USING (chunk_id))),
i AS (SELECT cell_id, doc, pos, pos - row_number() OVER (PARTITION BY cell_id, doc ORDER BY pos) AS g FROM e)
SELECT cell_id, doc, min(pos)::BIGINT AS span_start, max(pos)::BIGINT + 1 AS span_end FROM i GROUP BY cell_id, doc, g""")
def window_spans(spark, sf_dir):
    """Windows of two elements around what is shown, merged into spans (gaps and islands)."""
    s = _shown(spark, sf_dir).select("cell_id", "doc", F.explode(F.sequence(F.greatest(F.col("el_start") - 2, F.lit(0)), F.col("el_end") + 1)).alias("pos")).distinct()
    i = s.withColumn("g", F.col("pos") - F.row_number().over(Window.partitionBy("cell_id", "doc").orderBy("pos")))
    return i.groupBy("cell_id", "doc", "g").agg(F.min("pos").cast("bigint").alias("span_start"), (F.max("pos").cast("bigint") + 1).alias("span_end")).drop("g")


@query(f"""WITH {CELLS}, t AS (SELECT cell_id, doc, strategy FROM shown JOIN c USING (chunk_id) WHERE rank = 1)
SELECT cell_id, chunk_id FROM t JOIN c USING (doc, strategy)""")
def full_page(spark, sf_dir):
    """Every chunk of the page that the first chunk stands on."""
    top = _shown(spark, sf_dir).where("rank = 1").select("cell_id", "doc", "strategy")
    c = table(spark, sf_dir, "chunks").select("chunk_id", "doc", "strategy").distinct()
    return top.join(c, ["doc", "strategy"]).select("cell_id", "chunk_id")


@query(f"""WITH {CELLS}, o AS (SELECT cell_id, rank, el_end - el_start AS n FROM shown JOIN c USING (chunk_id)),
z AS (SELECT cell_id, rank, n, row_number() OVER (PARTITION BY cell_id ORDER BY rank) AS i FROM o)
SELECT cell_id, count(*) AS n_kept, sum(n)::BIGINT AS n_elements FROM (SELECT *, sum(n) OVER (PARTITION BY cell_id ORDER BY i) AS run FROM z) WHERE run <= 20 GROUP BY cell_id""")
def budget_prefix(spark, sf_dir):
    """How many of the ranked chunks fit a budget of 20 elements before the first that does not."""
    w = Window.partitionBy("cell_id").orderBy("rank")
    s = _shown(spark, sf_dir).withColumn("n", F.col("el_end") - F.col("el_start")).withColumn("run", F.sum("n").over(w)).where("run <= 20")
    return s.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("n").cast("bigint").alias("n_elements"))


@query(f"""WITH RECURSIVE {CELLS}, z AS (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY rank) AS i, el_end - el_start AS n FROM shown JOIN c USING (chunk_id)),
f(cell_id, i, used, kept) AS (SELECT cell_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT cell_id FROM z)
 UNION ALL SELECT z.cell_id, z.i, CASE WHEN used + n <= 20 THEN used + n ELSE used END, CASE WHEN used + n <= 20 THEN kept + 1 ELSE kept END FROM f JOIN z ON z.cell_id = f.cell_id AND z.i = f.i + 1)
SELECT cell_id, max(kept) AS n_kept, max(used) AS n_elements FROM f GROUP BY cell_id""")
def budget_fill(spark, sf_dir):
    """Greedy fill of a budget of 20 elements that skips what does not fit: a fold over each cell's short ranking."""
    s = _shown(spark, sf_dir).groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", (F.col("el_end") - F.col("el_start")).cast("bigint").alias("n")))), lambda x: x["n"]).alias("ns"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("kept"))
    fold = F.aggregate("ns", zero, lambda a, n: F.when(a["used"] + n <= 20, F.struct((a["used"] + n).alias("used"), (a["kept"] + 1).alias("kept"))).otherwise(a))
    return s.select("cell_id", fold.alias("f")).select("cell_id", F.col("f.kept").alias("n_kept"), F.col("f.used").alias("n_elements"))
