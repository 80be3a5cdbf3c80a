"""Frames of gold branches: signatures over two small taxonomies, unification, groups and decisions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import matching as X
from quernstone.operators import signatures as G
from quernstone.plans.materialize import materialize
from quernstone.queries._registry import family
from quernstone.queries.composition import PAIRED, instances, related
from quernstone.queries.matching import OTOK

QUERIES, ORACLES, query = family()

SOURCES = {"government_guidance": "official", "official_policy": "official", "product_terms": "provider", "faq": "provider", "category_page": "provider", "amendment": "provider", "third_party": "other", "official": "any", "provider": "any", "other": "any"}
ROOTS = {"source": "any", "where": "place"}


def frames(spark, sf_dir) -> DataFrame:
    """(frame, slot, value): of each branch the kind of its source and the place its scope names."""
    b = instances(spark, sf_dir).select("instance_id", "ps", F.explode("bs").alias("b"))
    kind = F.get(F.filter("ps", lambda p: p["id"] == F.col("b.supporting_passage")), F.lit(0))["source_type"]
    place = F.get(F.get("b.applicability.attributes", F.lit(0))["values"], F.lit(0))
    frame = F.concat_ws("/", "instance_id", "b.branch_id")
    return b.select(frame.alias("frame"), F.explode(F.array(F.struct(F.lit("source").alias("slot"), kind.alias("value")), F.struct(F.lit("where").alias("slot"), place.alias("value")))).alias("x")).select("frame", "x.*")


def taxonomy(spark, raw: DataFrame) -> DataFrame:
    """Kinds of sources as fixed; places that stand more than once under the ending of their names, which stand under the root."""
    fixed = spark.createDataFrame([("source", k, v) for k, v in SOURCES.items()], "slot string, value string, parent string")
    seen = raw.where("slot = 'where'").groupBy("slot", G.folded(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND length(value) > 4")
    places = seen.select("slot", "value", F.expr("right(value, 4)").alias("parent"))
    ends = places.select("slot", F.col("parent").alias("value")).distinct().withColumn("parent", F.lit("place"))
    return fixed.unionByName(places).unionByName(ends)


def _parts(spark, sf_dir):
    raw = materialize(frames(spark, sf_dir), "frames")
    tree = materialize(taxonomy(spark, raw), "taxonomy")
    sigs = materialize(G.signatures(raw, tree, ROOTS), "signatures")
    above = G.ancestors(tree)
    f = raw.select("frame", F.split_part("frame", F.lit("/"), F.lit(1)).alias("i")).distinct()
    pairs = f.select(F.col("frame").alias("a"), "i").join(f.select(F.col("frame").alias("b"), "i"), "i").where("a < b").select("a", "b")  # an instance has few branches
    return sigs, above, pairs


SRC = "(VALUES " + ", ".join(f"('source', '{k}', '{v}')" for k, v in SOURCES.items()) + ") t(slot, value, parent)"
SIGS = f"""{PAIRED}, fr0 AS (SELECT instance_id || '/' || b.branch_id AS frame, instance_id, list_filter(ps, lambda p: p.id = b.supporting_passage)[1].source_type AS k, b.applicability.attributes[1].values[1] AS w FROM (SELECT instance_id, any_value(passages) AS ps, unnest(any_value(gold_branches)) AS b FROM gold_instances WHERE instance_id IS NOT NULL GROUP BY instance_id)),
fr AS (SELECT frame, instance_id, 'source' AS slot, lower(trim(k)) AS value FROM fr0 UNION ALL SELECT frame, instance_id, 'where', lower(trim(w)) FROM fr0), pl AS (SELECT value, right(value, 4) AS parent FROM fr WHERE slot = 'where' AND length(value) > 4 GROUP BY value HAVING count(*) > 1),
tx AS (SELECT slot, value, parent FROM {SRC} UNION ALL SELECT 'where', value, parent FROM pl UNION ALL SELECT DISTINCT 'where', parent, 'place' FROM pl),
nd AS (SELECT slot, value FROM tx UNION SELECT slot, parent FROM tx), ab AS (SELECT slot, value, value AS ancestor FROM nd UNION SELECT slot, value, parent FROM tx UNION SELECT x.slot, x.value, y.parent FROM tx x JOIN tx y ON y.slot = x.slot AND y.value = x.parent),
sg AS (SELECT frame, instance_id, slot, CASE WHEN nd.value IS NOT NULL THEN fr.value END AS typed, CASE WHEN nd.value IS NULL THEN fr.value END AS untyped FROM fr LEFT JOIN nd USING (slot, value) WHERE fr.value <> '' AND fr.value NOT IN ('any', 'place')),
pf AS (SELECT x.frame AS a, y.frame AS b FROM fr0 x JOIN fr0 y ON x.instance_id = y.instance_id AND x.frame < y.frame), sl AS (SELECT a, b, slot FROM pf JOIN sg ON sg.frame = a UNION SELECT a, b, slot FROM pf JOIN sg ON sg.frame = b),
sj AS (SELECT sl.*, x.typed AS ta, x.untyped AS ua, y.typed AS tb, y.untyped AS ub FROM sl LEFT JOIN sg x ON x.frame = sl.a AND x.slot = sl.slot LEFT JOIN sg y ON y.frame = sl.b AND y.slot = sl.slot),
sr2 AS (SELECT a, b, slot, CASE WHEN ua IS NOT NULL AND ub IS NOT NULL THEN CASE WHEN ua = ub THEN 'equal' ELSE 'uncertain' END WHEN ua IS NOT NULL AND tb IS NULL THEN 'b_broader' WHEN ub IS NOT NULL AND ta IS NULL THEN 'a_broader' WHEN ua IS NOT NULL OR ub IS NOT NULL THEN 'uncertain' WHEN ta IS NULL THEN 'a_broader' WHEN tb IS NULL THEN 'b_broader' WHEN ta = tb THEN 'equal'
 WHEN EXISTS (SELECT 1 FROM ab WHERE ab.slot = sj.slot AND ab.value = tb AND ab.ancestor = ta) THEN 'a_broader' WHEN EXISTS (SELECT 1 FROM ab WHERE ab.slot = sj.slot AND ab.value = ta AND ab.ancestor = tb) THEN 'b_broader' ELSE 'incompatible' END AS relation FROM sj),
un0 AS (SELECT pf.a, pf.b, coalesce(bool_or(relation = 'incompatible'), false) AS inc, coalesce(bool_or(relation = 'uncertain'), false) AS unc, coalesce(bool_or(relation = 'a_broader'), false) AS ab, coalesce(bool_or(relation = 'b_broader'), false) AS bb FROM pf LEFT JOIN sr2 USING (a, b) GROUP BY pf.a, pf.b),
un AS (SELECT a, b, CASE WHEN inc THEN 'distinct' WHEN unc THEN 'uncertain' WHEN ab AND bb THEN 'overlap' WHEN ab OR bb THEN 'subsumes' ELSE 'equivalent' END AS kind, CASE WHEN inc OR unc OR (ab AND bb) THEN NULL WHEN ab THEN 'a' WHEN bb THEN 'b' END AS general FROM un0)"""


@query(f"WITH {SIGS} SELECT frame, slot, typed, untyped FROM sg")
def frame_signatures(spark, sf_dir):
    """Slots of each frame: values of the vocabulary, and what it does not know."""
    return _parts(spark, sf_dir)[0]


@query(f"WITH {SIGS} SELECT a, b, slot, relation FROM sr2")
def slot_relations(spark, sf_dir):
    """How two frames of an instance lie in each slot."""
    sigs, above, pairs = _parts(spark, sf_dir)
    return G.slot_relations(pairs, sigs, above)


@query(f"WITH {SIGS} SELECT a, b, kind, general FROM un")
def unified_frames(spark, sf_dir):
    """Whether two frames of an instance speak of one thing, and which is the broader statement."""
    sigs, above, pairs = _parts(spark, sf_dir)
    return G.unify(pairs, G.slot_relations(pairs, sigs, above))


# an instance has two frames at most in these tables, so a group is a pair or a frame alone
@query(f"WITH {SIGS}, j AS (SELECT a, b FROM un WHERE kind IN ('equivalent', 'subsumes', 'overlap')), f AS (SELECT a AS frame FROM un UNION SELECT b FROM un) SELECT frame, least(frame, coalesce(j.a, frame)) AS \"group\" FROM f LEFT JOIN j ON j.b = frame")
def frame_groups(spark, sf_dir):
    """Frames that speak of one thing, as connected components."""
    sigs, above, pairs = _parts(spark, sf_dir)
    return G.coreferent(G.unify(pairs, G.slot_relations(pairs, sigs, above)))


@query(f"WITH {SIGS}, n AS (SELECT a, b, slot, CASE WHEN relation = 'b_broader' THEN 'a' ELSE 'b' END AS side FROM sr2 WHERE relation IN ('a_broader', 'b_broader')), o AS (SELECT n.*, sg.typed FROM n JOIN sg ON sg.slot = n.slot AND sg.frame = CASE WHEN side = 'a' THEN a ELSE b END WHERE typed IS NOT NULL) SELECT o.a, o.b, side, o.slot, count(DISTINCT ab.value) AS n_values, min(ab.value) AS first_value FROM o JOIN ab ON ab.slot = o.slot AND ab.ancestor = o.typed GROUP BY ALL")
def narrowed_scopes(spark, sf_dir):
    """The values by which the narrower side's scope is narrowed in each slot."""
    sigs, above, pairs = _parts(spark, sf_dir)
    n = G.folded_values(G.slot_relations(pairs, sigs, above), sigs, above)
    return n.select("a", "b", "side", "slot", F.size("values").cast("bigint").alias("n_values"), F.col("values")[0].alias("first_value"))


@query(f"""WITH {SIGS}, d AS (SELECT rr.instance_id, un.kind, rr.relation, rr.same, coalesce(list_has_any({OTOK("coalesce(oa, '')")}, {OTOK("coalesce(ob, '')")}), false) OR {OTOK("coalesce(oa, '')")} = {OTOK("coalesce(ob, '')")} AS comm FROM rr JOIN un ON un.a = rr.instance_id || '/' || rr.a AND un.b = rr.instance_id || '/' || rr.b),
e AS (SELECT instance_id, CASE WHEN kind IN ('distinct', 'uncertain') OR NOT comm THEN NULL WHEN relation = 'unknown' THEN 'unknown' WHEN relation = 'disjoint' THEN 'disjoint' WHEN same THEN 'redundant' WHEN relation = 'equal' THEN 'same_scope' WHEN relation = 'overlapping' THEN 'crossing' ELSE 'conditional' END AS decision, CASE WHEN same THEN 0.0 ELSE 1.0 END AS score FROM d)
SELECT instance_id, arg_max(decision, (CASE decision WHEN 'conditional' THEN 5 WHEN 'crossing' THEN 4 WHEN 'same_scope' THEN 4 WHEN 'redundant' THEN 3 WHEN 'disjoint' THEN 2 ELSE 1 END, score, decision)) AS decision, max(score)::DOUBLE AS score FROM e WHERE decision IS NOT NULL GROUP BY instance_id""")
def frame_decisions(spark, sf_dir):
    """The strongest decision of each instance: frames that unify and speak of a common matter, by scopes and outcomes."""
    sigs, above, pairs = _parts(spark, sf_dir)
    u = G.unify(pairs, G.slot_relations(pairs, sigs, above))
    r = related(spark, sf_dir)
    at = lambda c: F.concat_ws("/", "instance_id", c)
    j = r.withColumn("fa", at("a")).withColumn("fb", at("b")).drop("a", "b").join(u.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "kind"), ["fa", "fb"])
    ta, tb = X.outcome_tokens(F.col("oa")), X.outcome_tokens(F.col("ob"))
    d = j.select("instance_id", G.decision(F.col("kind"), F.arrays_overlap(ta, tb) | (ta == tb), F.col("relation"), F.col("same"), F.lit(False)).alias("decision"), F.when(F.col("same"), 0.0).otherwise(1.0).alias("score"))
    return G.strongest(d, ["instance_id"])
