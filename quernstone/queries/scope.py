"""Scopes of gold branches, routing, taxonomies and intervals."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import scope as S
from quernstone.queries._registry import family
from quernstone.queries.pairs import gold
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()


def branches(spark, sf_dir) -> DataFrame:
    b = gold(spark, sf_dir).select("instance_id", F.explode("gold_branches").alias("b"))
    return b.select("instance_id", F.col("b.branch_id").alias("branch_id"), "b.outcome", F.coalesce("b.applicability.is_default", F.lit(False)).alias("is_default"), S.attributes(F.col("b.applicability.attributes")).alias("attributes"))


BR = """gb AS (SELECT instance_id, any_value(gold_branches) AS bs FROM gold_instances GROUP BY 1), br AS (SELECT instance_id, b.branch_id AS bid, b.outcome AS outcome, coalesce(b.applicability.is_default, false) AS def, b.applicability.attributes AS ats FROM (SELECT instance_id, unnest(bs) AS b FROM gb)),
av AS (SELECT instance_id, bid, lower(trim(a.name)) AS name, a.kind AS kind, list_transform(coalesce(a.values, []), lambda v: lower(trim(v))) AS vals, coalesce(a.min_value, '-inf'::DOUBLE) AS lo, coalesce(a.max_value, 'inf'::DOUBLE) AS hi, a.boolean_value AS flag FROM (SELECT instance_id, bid, unnest(ats) AS a FROM br)),
pb AS (SELECT a.instance_id, a.bid AS a, b.bid AS b, a.def AS da, b.def AS db, a.outcome = b.outcome AS agree, coalesce(len(a.ats), 0) AS na, coalesce(len(b.ats), 0) AS nb, len(list_filter(list_concat(a.ats, b.ats), lambda t: t.kind NOT IN ('categorical', 'ordered_tier', 'numeric', 'numeric_range', 'boolean'))) > 0 AS free FROM br a JOIN br b ON a.instance_id = b.instance_id AND a.bid < b.bid),
ar AS (SELECT x.instance_id, x.bid AS a, y.bid AS b, CASE WHEN x.kind NOT IN ('categorical', 'ordered_tier', 'numeric', 'numeric_range', 'boolean') OR y.kind NOT IN ('categorical', 'ordered_tier', 'numeric', 'numeric_range', 'boolean') THEN 'unknown' WHEN x.kind <> y.kind THEN 'overlapping'
 WHEN x.kind IN ('categorical', 'ordered_tier') THEN CASE WHEN len(list_intersect(x.vals, y.vals)) = 0 THEN 'disjoint' WHEN len(list_intersect(x.vals, y.vals)) = len(list_distinct(x.vals)) AND len(list_intersect(x.vals, y.vals)) = len(list_distinct(y.vals)) THEN 'equal' WHEN len(list_intersect(x.vals, y.vals)) = len(list_distinct(x.vals)) THEN 'subset' WHEN len(list_intersect(x.vals, y.vals)) = len(list_distinct(y.vals)) THEN 'superset' ELSE 'overlapping' END
 WHEN x.kind IN ('numeric', 'numeric_range') THEN CASE WHEN x.lo > y.hi OR y.lo > x.hi THEN 'disjoint' WHEN x.lo = y.lo AND x.hi = y.hi THEN 'equal' WHEN x.lo >= y.lo AND x.hi <= y.hi THEN 'subset' WHEN y.lo >= x.lo AND y.hi <= x.hi THEN 'superset' ELSE 'overlapping' END
 WHEN x.kind = 'boolean' THEN CASE WHEN x.flag IS NOT DISTINCT FROM y.flag THEN 'equal' ELSE 'disjoint' END ELSE 'unknown' END AS r FROM av x JOIN av y ON x.instance_id = y.instance_id AND x.bid < y.bid AND x.name = y.name),
sr AS (SELECT instance_id, a, b, count(*) AS ns, bool_or(r = 'disjoint') AS dis, bool_or(r = 'unknown') AS unk, bool_and(r IN ('equal', 'subset')) AS sub, bool_and(r IN ('equal', 'superset')) AS sup FROM ar GROUP BY ALL),
rel AS (SELECT pb.*, CASE WHEN da AND db THEN 'equal' WHEN da THEN 'superset' WHEN db THEN 'subset' WHEN na = 0 OR nb = 0 THEN 'unknown' WHEN dis THEN 'disjoint' WHEN free THEN 'unknown' WHEN ns IS NULL THEN 'overlapping' WHEN sub AND nb = ns AND sup AND na = ns THEN 'equal' WHEN sub AND nb = ns THEN 'subset' WHEN sup AND na = ns THEN 'superset' ELSE 'overlapping' END AS relation FROM pb LEFT JOIN sr USING (instance_id, a, b)),
vd AS (SELECT *, CASE WHEN relation = 'disjoint' THEN 'disjoint' WHEN relation = 'unknown' THEN 'opposed' WHEN agree THEN 'redundant' WHEN relation IN ('subset', 'superset') THEN 'refinement' ELSE 'opposed' END AS verdict FROM rel)"""


def _related(spark, sf_dir):
    b = branches(spark, sf_dir)
    a = b.select("instance_id", *[F.col(c).alias(f"a_{c}") for c in b.columns[1:]])
    p = a.join(b, "instance_id").where("a_branch_id < branch_id")
    rel = S.scope_relation(F.col("a_attributes"), F.col("attributes"), F.col("a_is_default"), F.col("is_default"))
    return p.select("instance_id", F.col("a_branch_id").alias("a"), F.col("branch_id").alias("b"), rel.alias("relation"), (F.col("a_outcome") == F.col("outcome")).alias("agree"))


@query(f"WITH {BR} SELECT instance_id, a, b, relation, CASE WHEN relation = 'unknown' THEN NULL ELSE relation <> 'disjoint' END AS meet, verdict FROM vd")
def scope_relations(spark, sf_dir):
    """How the scopes of every two branches of an instance lie, whether they meet, and what follows."""
    return _related(spark, sf_dir).select("instance_id", "a", "b", "relation", S.intersects(F.col("relation")).alias("meet"), S.verdict(F.col("relation"), F.col("agree")).alias("verdict"))


@query(f"""WITH {BR}, gi AS (SELECT instance_id, any_value(gold_scope_relation) AS gold FROM gold_instances GROUP BY 1) SELECT coalesce(gold, 'none') AS gold, verdict AS predicted, count(*) AS n FROM vd JOIN gi USING (instance_id) GROUP BY ALL""")
def scope_confusion(spark, sf_dir):
    """Gold scope relations against those the algebra finds."""
    g = gold(spark, sf_dir).select("instance_id", F.coalesce("gold_scope_relation", F.lit("none")).alias("gold"))
    r = _related(spark, sf_dir).select("instance_id", S.verdict(F.col("relation"), F.col("agree")).alias("predicted"))
    return r.join(g, "instance_id").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query()
def partition_regions(spark, sf_dir):
    """Regions of the case space of each instance's branches (tested against enumeration of cases)."""
    return S.partition(branches(spark, sf_dir).withColumnRenamed("branch_id", "frame"), "instance_id")


@query("""WITH s AS (SELECT p_brand AS brand, floor(p_retailprice / 50) * 50 AS lo, floor(p_retailprice / 50) * 50 + p_size AS hi FROM part), o AS (SELECT *, max(hi) OVER (PARTITION BY brand ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR lo > b THEN 1 ELSE 0 END) OVER (PARTITION BY brand ORDER BY lo, hi) AS g FROM o) SELECT brand, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY brand, g""")
def merged_price_bands(spark, sf_dir):
    """Price bands of each brand, merged where they touch."""
    lo = (F.floor(F.col("p_retailprice") / 50) * 50).cast("double")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), lo.alias("lo"), (lo + F.col("p_size")).alias("hi"))
    return S.merged_intervals(p, ["brand"], "lo", "hi")


TAX = """tx AS (SELECT 'n:' || n_name AS child, 'r:' || r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 's:' || s_name, 'n:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'r:' || r_name, 'world' FROM region),
nd AS (SELECT child AS node FROM tx UNION SELECT parent FROM tx), cl(node, ancestor, distance) AS (SELECT node, node, 0::BIGINT FROM nd UNION ALL SELECT cl.node, tx.parent, distance + 1 FROM cl JOIN tx ON tx.child = cl.ancestor)"""


@query(f"WITH RECURSIVE {TAX} SELECT node, ancestor, min(distance) AS distance FROM cl GROUP BY ALL")
def taxonomy_closure(spark, sf_dir):
    """Ancestors of every supplier, nation and region."""
    t = lambda n: table(spark, sf_dir, n)
    tag = lambda k, c: F.concat(F.lit(k), F.col(c))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(tag("n:", "n_name").alias("child"), tag("r:", "r_name").alias("parent"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(tag("s:", "s_name").alias("child"), tag("n:", "n_name").alias("parent"))
    r = t("region").select(tag("r:", "r_name").alias("child"), F.lit("world").alias("parent"))
    return S.closure(n.unionByName(s).unionByName(r))


@query("""WITH b AS (SELECT * FROM (VALUES (1, 0, 10), (2, 11, 20), (3, 15, 35), (4, 36, 50)) t(band, lo, hi)) SELECT p_partkey, band::BIGINT AS band FROM part JOIN b ON p_size >= lo AND p_size <= hi""")
def point_in_region(spark, sf_dir):
    """Which closed bands hold each part's size: a range join against a fixed table of bands."""
    b = spark.createDataFrame([(1, 0, 10), (2, 11, 20), (3, 15, 35), (4, 36, 50)], "band bigint, lo int, hi int")
    p = table(spark, sf_dir, "part")
    return p.join(F.broadcast(b), (p["p_size"] >= b["lo"]) & (p["p_size"] <= b["hi"])).select("p_partkey", "band")
