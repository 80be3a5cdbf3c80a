"""Gold instances: routing, exceptions, labels, strata, preservation, grounding, sources and the rules records keep."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import outcomes as O
from quernstone.functions import text as T
from quernstone.operators import matching as X
from quernstone.operators import metrics as M
from quernstone.operators import scope as S
from quernstone.queries._registry import family
from quernstone.queries.matching import CANON, COUNTED, LIST, OTOK, chain, match_sql
from quernstone.queries.pairs import AUTHORITY, RECS, TOPSIS, _dated, gold, topsis_credibility
from quernstone.queries.scope import BR, branches
from quernstone.queries.text import SPACE

QUERIES, ORACLES, query = family()

GI = "gi AS (SELECT instance_id, any_value(construction) AS construction, any_value(separation) AS separation, any_value(split) AS split, any_value(gold_conflict_type) AS ctype, any_value(gold_scope_relation) AS rel, any_value(gold_opposition) AS opp, any_value(passages) AS ps, any_value(gold_branches) AS bs, any_value(is_distractor) AS dist, any_value(contract_version) AS version, any_value(query) AS query FROM gold_instances WHERE instance_id IS NOT NULL GROUP BY instance_id)"


def instances(spark, sf_dir) -> DataFrame:
    g = gold(spark, sf_dir).where("instance_id IS NOT NULL")
    return g.withColumnsRenamed({"gold_conflict_type": "ctype", "gold_scope_relation": "rel", "gold_opposition": "opp", "gold_branches": "bs", "passages": "ps"})


# whether the outcomes of two branches of an instance say the same, each pair of texts compared once
PAIRED = f"""{BR}, kk AS (SELECT DISTINCT a.outcome AS g0, b.outcome AS p0 FROM br a JOIN br b ON a.instance_id = b.instance_id AND a.bid < b.bid WHERE a.outcome IS NOT NULL AND b.outcome IS NOT NULL),
kv AS (SELECT g0, p0, {CANON('g0')} AS g, {CANON('p0')} AS p FROM kk), kf AS (SELECT *, {COUNTED('g')} AS fg, {COUNTED('p')} AS fp FROM kv), {match_sql('kv', 'g0, p0')},
same AS (SELECT kf.g0, kf.p0, (kf.g0 = kf.p0) OR (om.m AND trim(kf.g0) <> '' AND trim(kf.p0) <> '' AND len(list_filter(list_intersect(list_transform(fg, lambda x: split_part(x, ' ', 1)), list_transform(fp, lambda x: split_part(x, ' ', 1))), lambda y: NOT list_has_any(list_filter(fg, lambda x: split_part(x, ' ', 1) = y), list_filter(fp, lambda x: split_part(x, ' ', 1) = y)))) = 0) AS same FROM kf JOIN om USING (g0, p0)),
rr AS (SELECT r.instance_id, r.a, r.b, r.da, r.db, r.relation, coalesce(s.same, false) AS same, x.outcome AS oa, y.outcome AS ob FROM rel r JOIN br x ON x.instance_id = r.instance_id AND x.bid = r.a JOIN br y ON y.instance_id = r.instance_id AND y.bid = r.b LEFT JOIN same s ON s.g0 = x.outcome AND s.p0 = y.outcome)"""


def related(spark, sf_dir) -> DataFrame:
    """(instance_id, a, b, da, db, oa, ob, relation, same) of every two branches of an instance."""
    b = branches(spark, sf_dir)
    a = b.select("instance_id", *[F.col(c).alias(f"a_{c}") for c in b.columns[1:]])
    p = a.join(b, "instance_id").where("a_branch_id < branch_id")
    rel = S.scope_relation(F.col("a_attributes"), F.col("attributes"), F.col("a_is_default"), F.col("is_default"))
    p = p.select("instance_id", F.col("a_branch_id").alias("a"), F.col("branch_id").alias("b"), F.col("a_is_default").alias("da"), F.col("is_default").alias("db"), F.col("a_outcome").alias("oa"), F.col("outcome").alias("ob"), rel.alias("relation"))
    texts = p.where("oa IS NOT NULL AND ob IS NOT NULL").select("oa", "ob").distinct()
    texts = texts.withColumn("same", (F.col("oa") == F.col("ob")) | X.values_match(F.col("oa"), F.col("ob")))
    return p.join(texts, ["oa", "ob"], "left").withColumn("same", F.coalesce("same", F.lit(False)))


# regions of at most two branches, which are all these tables hold, from the relation of the two
ORACLES["partition_regions"] = f"""WITH {PAIRED}, nb AS (SELECT br.*, count(*) OVER (PARTITION BY instance_id) AS n, coalesce(len(ats), 0) > 0 AS typed FROM br),
one AS (SELECT * FROM nb WHERE n = 1), two AS (SELECT rr.*, rr.relation IN ('subset', 'equal') AS a_in_b, rr.relation IN ('superset', 'equal') AS b_in_a, rr.relation = 'disjoint' AS apart FROM rr)
SELECT instance_id, bid AS inside, bid AS governing, outcome, 'assigned' AS status FROM one WHERE def OR typed UNION ALL SELECT instance_id, '', '', NULL, 'uncovered' FROM one WHERE NOT def AND typed
UNION ALL SELECT instance_id, a, a, oa, 'assigned' FROM two WHERE NOT a_in_b UNION ALL SELECT instance_id, b, b, ob, 'assigned' FROM two WHERE NOT b_in_a UNION ALL SELECT instance_id, '', '', NULL, 'uncovered' FROM two WHERE NOT da AND NOT db
UNION ALL SELECT instance_id, a || ' ' || b, CASE WHEN a_in_b AND NOT b_in_a THEN a WHEN b_in_a AND NOT a_in_b THEN b ELSE a || ' ' || b END, CASE WHEN a_in_b AND NOT b_in_a THEN oa WHEN b_in_a AND NOT a_in_b THEN ob WHEN same THEN oa END,
 CASE WHEN a_in_b <> b_in_a OR same THEN 'assigned' ELSE 'contested' END FROM two WHERE NOT apart"""


@query(f"WITH {PAIRED} SELECT instance_id, a, b, relation, same, CASE WHEN relation = 'subset' THEN a WHEN relation = 'superset' THEN b END AS narrower, CASE WHEN da OR db OR same THEN NULL WHEN relation IN ('subset', 'superset') THEN 'nested' WHEN relation IN ('equal', 'overlapping') THEN 'crossed' END AS flag FROM rr")
def exception_pairs(spark, sf_dir):
    """Every two branches: how their scopes lie, whether they say the same, the narrower one, and exceptions that nest or cross."""
    r = related(spark, sf_dir)
    flag = F.when(~F.col("da") & ~F.col("db"), S.exception_pair(F.col("relation"), F.col("same")))
    return r.select("instance_id", "a", "b", "relation", "same", S.narrower(F.col("relation"), F.col("a"), F.col("b")).alias("narrower"), flag.alias("flag"))


@query(f"""WITH {PAIRED}, {GI}, fl AS (SELECT instance_id, max(CASE WHEN da OR db OR same THEN NULL WHEN relation IN ('subset', 'superset') THEN 2 WHEN relation IN ('equal', 'overlapping') THEN 1 END) AS f FROM rr GROUP BY instance_id),
bs AS (SELECT instance_id, ctype, rel, f, CASE WHEN ctype = 'no_conflict' THEN 'pass_through' WHEN ctype <> 'conditional' THEN 'prior_work' WHEN rel IN ('refinement', 'disjoint') THEN 'compose' WHEN rel = 'redundant' THEN 'merge' WHEN rel = 'opposed' THEN 'select' ELSE 'invalid' END AS base FROM gi LEFT JOIN fl USING (instance_id)),
ac AS (SELECT *, CASE WHEN base = 'compose' AND f IS NOT NULL THEN 'select' ELSE base END AS action, CASE WHEN base = 'compose' THEN CASE f WHEN 2 THEN 'nested' WHEN 1 THEN 'crossed' END END AS flag FROM bs) SELECT action, flag, count(*) AS n FROM ac GROUP BY ALL""")
def routed_actions(spark, sf_dir):
    """What is done with an instance by its conflict type and relation; composing gives way where exceptions nest or cross."""
    order = F.when(F.col("da") | F.col("db") | F.col("same"), F.lit(None)).when(F.col("relation").isin("subset", "superset"), 2).when(F.col("relation").isin("equal", "overlapping"), 1)
    f = related(spark, sf_dir).groupBy("instance_id").agg(F.max(order).alias("f"))
    base = F.when(F.col("ctype") == "no_conflict", "pass_through").when(F.col("ctype") != "conditional", "prior_work").when(F.col("rel").isin("refinement", "disjoint"), "compose").when(F.col("rel") == "redundant", "merge").when(F.col("rel") == "opposed", "select").otherwise("invalid")
    d = instances(spark, sf_dir).join(f, "instance_id", "left").select(base.alias("base"), "f")
    action = F.when((F.col("base") == "compose") & F.col("f").isNotNull(), "select").otherwise(F.col("base"))
    flag = F.when(F.col("base") == "compose", F.when(F.col("f") == 2, "nested").when(F.col("f") == 1, "crossed"))
    return d.groupBy(action.alias("action"), flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAIRED}, rs AS (SELECT instance_id, CASE WHEN da THEN b ELSE a END AS bid FROM rr WHERE da <> db AND same), k AS (SELECT br.instance_id, br.bid, br.def, br.outcome FROM br LEFT JOIN rs USING (instance_id, bid) WHERE rs.bid IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY def DESC, bid) - 1 AS i FROM k) SELECT instance_id, count(*) AS n_branches, string_agg('b' || i || ': ' || coalesce(outcome, ''), '; ' ORDER BY i) AS answer FROM o GROUP BY instance_id""")
def merged_answers(spark, sf_dir):
    """Branches without the exceptions that only restate the default, the default first, numbered anew and put into words."""
    r = related(spark, sf_dir).where("da <> db AND same").select("instance_id", F.when(F.col("da"), F.col("b")).otherwise(F.col("a")).alias("branch_id"))
    k = branches(spark, sf_dir).join(r, ["instance_id", "branch_id"], "left_anti")
    w = Window.partitionBy("instance_id").orderBy(F.desc("is_default"), "branch_id")
    o = k.withColumn("i", F.row_number().over(w) - 1)
    said = F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("outcome", F.lit("")).alias("o")))), lambda x: F.concat(F.lit("b"), x["i"].cast("string"), F.lit(": "), x["o"]))
    return o.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_branches"), F.array_join(said, "; ").alias("answer"))


OPP = """CASE WHEN rel <> 'opposed' OR rel IS NULL THEN NULL WHEN opp IS NOT NULL THEN opp WHEN len(list_filter(bs, lambda b: coalesce(b.applicability.is_default, false))) > 0 OR len(list_filter(bs, lambda b: NOT coalesce(b.applicability.is_default, false))) < 2 THEN 'unknown'
 WHEN len(list_distinct(list_transform(list_filter(bs, lambda b: NOT coalesce(b.applicability.is_default, false)), lambda b: b.applicability.descriptor))) = 1 THEN 'same_scope' ELSE 'crossing' END"""
LABEL = "CASE WHEN ctype <> 'conditional' THEN ctype WHEN rel = 'refinement' THEN 'conditional_conflict' WHEN rel IN ('disjoint', 'redundant') THEN 'no_conflict' WHEN rel = 'opposed' THEN CASE o WHEN 'unknown' THEN 'opposed_undecided' ELSE o END ELSE 'invalid' END"
SYNTHETIC = "terms."
STRATUM = f"CASE WHEN len(list_filter(ps, lambda p: contains(coalesce(p.source_url, ''), '{SYNTHETIC}'))) = len(ps) THEN 'authored' WHEN label = 'conditional_conflict' THEN coalesce(separation, 'unrecorded') WHEN label = 'crossing' THEN 'contrast' ELSE 'control' END"
LAB = f"{GI}, lb0 AS (SELECT *, {OPP} AS o FROM gi), lb1 AS (SELECT *, {LABEL} AS label FROM lb0), lb AS (SELECT *, {STRATUM} AS stratum FROM lb1)"


def labelled(spark, sf_dir) -> DataFrame:
    """Instances with opposition, label and stratum by fixed rules in order."""
    d = instances(spark, sf_dir)
    default = lambda b: F.coalesce(b["applicability"]["is_default"], F.lit(False))
    conditioned = F.filter("bs", lambda b: ~default(b))
    crossing = F.size(F.array_distinct(F.transform(conditioned, lambda b: b["applicability"]["descriptor"]))) > 1
    o = F.when(F.col("rel") == "opposed", F.coalesce("opp", F.when(F.exists("bs", default) | (F.size(conditioned) < 2), "unknown").when(crossing, "crossing").otherwise("same_scope")))
    d = d.withColumn("o", o)
    label = F.when(F.col("ctype") != "conditional", F.col("ctype")).when(F.col("rel") == "refinement", "conditional_conflict").when(F.col("rel").isin("disjoint", "redundant"), "no_conflict")
    label = label.when(F.col("rel") == "opposed", F.when(F.col("o") == "unknown", "opposed_undecided").otherwise(F.col("o"))).otherwise("invalid")
    d = d.withColumn("label", label)
    authored = F.forall("ps", lambda p: F.coalesce(F.contains(p["source_url"], F.lit(SYNTHETIC)), F.lit(False)))
    s = F.when(authored, "authored").when(F.col("label") == "conditional_conflict", F.coalesce("separation", F.lit("unrecorded"))).when(F.col("label") == "crossing", "contrast").otherwise("control")
    return d.withColumn("stratum", s)


@query(f"WITH {LAB} SELECT ctype, rel, o AS opposition, label, count(*) AS n FROM lb GROUP BY ALL")
def relabelled(spark, sf_dir):
    """Conflict type, relation and opposition mapped to one label."""
    return labelled(spark, sf_dir).groupBy("ctype", "rel", F.col("o").alias("opposition"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LAB} SELECT stratum, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test, count(*) AS n FROM lb GROUP BY stratum")
def strata_by_split(spark, sf_dir):
    """Strata against splits, pivoted."""
    return labelled(spark, sf_dir).groupBy("stratum").agg(*[M.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test")], F.count(F.lit(1)).alias("n"))


TARGETS = {"same_guide": 40, "natural": 300, "synthetic": 100, "cross_document": 120}
ROWS = "CASE WHEN separation = 'same_guide' THEN 'same_guide' WHEN separation = 'cross_document' THEN 'cross_document' WHEN construction = 'natural' THEN 'natural' ELSE 'synthetic' END"


@query(f"WITH {LAB}, r AS (SELECT {ROWS} AS bucket, count(*) AS n FROM lb GROUP BY 1), t AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {v}::BIGINT)' for k, v in TARGETS.items())}) t(bucket, target)) SELECT bucket, target, coalesce(n, 0)::BIGINT AS n, greatest(target - coalesce(n, 0), 0)::BIGINT AS shortfall FROM t LEFT JOIN r USING (bucket)")
def corpus_progress(spark, sf_dir):
    """Instances of each reporting row against its target."""
    row = F.when(F.col("separation") == "same_guide", "same_guide").when(F.col("separation") == "cross_document", "cross_document").when(F.col("construction") == "natural", "natural").otherwise("synthetic")
    n = labelled(spark, sf_dir).groupBy(row.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    t = spark.createDataFrame(list(TARGETS.items()), "bucket string, target bigint")
    return t.join(n, "bucket", "left").select("bucket", "target", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("shortfall"))


@query(f"""WITH {LAB}, h AS (SELECT construction, len(list_distinct(list_filter(list_transform(ps, lambda p: p.document_id), lambda d: d IS NOT NULL))) AS nd, len(list_filter(ps, lambda p: p.source_url IS NOT NULL)) AS nu, ctype, separation FROM lb)
SELECT CASE WHEN nu = 0 THEN 'no_source' WHEN nd > 1 THEN 'documents' WHEN nd = 1 THEN 'one_document' ELSE 'unknown_documents' END AS provenance, count(*) AS n, count(*) FILTER (ctype = 'conditional' AND (construction = 'natural' OR separation = 'same_guide')) AS n_natural_conditional FROM h GROUP BY 1""")
def provenance_counts(spark, sf_dir):
    """Where passages come from, and the conditional conflicts that occur by nature."""
    nd = F.size(F.array_distinct(F.array_compact(F.transform("ps", lambda p: p["document_id"]))))
    nu = F.size(F.filter("ps", lambda p: p["source_url"].isNotNull()))
    natural = (F.col("ctype") == "conditional") & ((F.col("construction") == "natural") | (F.col("separation") == "same_guide"))
    return instances(spark, sf_dir).groupBy(F.when(nu == 0, "no_source").when(nd > 1, "documents").when(nd == 1, "one_document").otherwise("unknown_documents").alias("provenance")).agg(F.count(F.lit(1)).alias("n"), M.count_if(natural).alias("n_natural_conditional"))


JUDGED = f"""{GI}, jb AS (SELECT instance_id, construction, b.branch_id AS bid, coalesce(b.applicability.is_default, false) AS def, coalesce(b.explicitness, 'unrecorded') AS explicitness, b.supporting_passage AS sup, ps, {OTOK("coalesce(b.outcome, '')")} AS tg, {OTOK("coalesce(list_filter(ps, lambda p: p.id = b.supporting_passage)[1].text, '')")} AS tp
 FROM (SELECT instance_id, construction, ps, unnest(bs) AS b FROM gi)),
jd AS (SELECT *, CASE WHEN coalesce(len(list_intersect(tg, tp)) / nullif(len(tg), 0), 0) >= 0.6 THEN 'preserved' WHEN coalesce(len(list_intersect(tg, tp)) / nullif(len(list_distinct(list_concat(tg, tp))), 0), 0) >= 0.25 THEN 'distorted' ELSE 'suppressed' END AS verdict,
 sup IS NULL OR NOT list_contains(list_transform(ps, lambda p: p.id), sup) AS ungrounded FROM jb)"""


def judged(spark, sf_dir) -> DataFrame:
    """Each gold branch against the text of its passage: preserved, distorted or suppressed, and whether its citation exists."""
    d = instances(spark, sf_dir).select("instance_id", "construction", "ps", F.explode("bs").alias("b"))
    text = F.get(F.filter("ps", lambda p: p["id"] == F.col("b.supporting_passage")), F.lit(0))["text"]
    d = d.select("*", X.outcome_tokens(F.col("b.outcome")).alias("tg"), X.outcome_tokens(text).alias("tp"))
    v = F.when(T.containment(F.col("tg"), F.col("tp")) >= 0.6, "preserved").when(T.jaccard(F.col("tg"), F.col("tp")) >= 0.25, "distorted").otherwise("suppressed")
    ids = F.transform("ps", lambda p: p["id"])
    return d.select("instance_id", "construction", F.coalesce("b.applicability.is_default", F.lit(False)).alias("def"), F.coalesce("b.explicitness", F.lit("unrecorded")).alias("explicitness"), v.alias("verdict"), (F.col("b.supporting_passage").isNull() | ~F.array_contains(ids, F.col("b.supporting_passage"))).alias("ungrounded"))


PRES = "count(*) AS n, round(avg((verdict = 'preserved')::INT), 6) AS preserved, round(avg((verdict = 'suppressed')::INT), 6) AS suppressed, round(avg((verdict = 'distorted')::INT), 6) AS distorted, count(*) FILTER (ungrounded) AS n_ungrounded, round(coalesce(count(*) FILTER (NOT def AND verdict = 'preserved') / nullif(count(*) FILTER (NOT def), 0), 0), 6) AS exceptions_preserved"


def _preserved() -> list[Column]:
    share = lambda v: F.round(F.avg((F.col("verdict") == v).cast("int")), 6).alias(v)
    e = ~F.col("def")
    return [F.count(F.lit(1)).alias("n"), share("preserved"), share("suppressed"), share("distorted"), M.count_if(F.col("ungrounded")).alias("n_ungrounded"), F.round(M.ratio(M.count_if(e & (F.col("verdict") == "preserved")), M.count_if(e)), 6).alias("exceptions_preserved")]


@query(f"WITH {JUDGED} SELECT construction, {PRES} FROM jd GROUP BY GROUPING SETS ((construction), ())")
def preservation(spark, sf_dir):
    """Branches whose outcome stands in the text they cite, per construction and in all."""
    return judged(spark, sf_dir).rollup("construction").agg(*_preserved())


@query(f"WITH {JUDGED} SELECT explicitness, {PRES} FROM jd GROUP BY explicitness")
def preservation_by_explicitness(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("explicitness").agg(*_preserved())


KW = f"{GI}, kb AS (SELECT instance_id, ps, b.branch_id AS bid, {CANON('b.outcome')} AS canon FROM (SELECT instance_id, ps, unnest(bs) AS b FROM gi) WHERE b.outcome IS NOT NULL), kq AS (SELECT *, list_transform({COUNTED('canon')}, lambda x: split_part(x, ' ', 2) || CASE WHEN split_part(x, ' ', 1) = '%' THEN '%' ELSE '' END) AS figs FROM kb)"
TEXTS = chain("lower(list_reduce(list_transform(ps, lambda p: coalesce(p.text, '')), lambda a, b: a || chr(10) || b))", [*O.figure_steps(), (r"\bp\d+\b", " ")])


@query(f"""WITH {KW}, ks AS (SELECT instance_id, ps, bid, CASE WHEN len(figs) > 0 THEN list_distinct(figs) ELSE [canon] END AS kws FROM kq), ex AS (SELECT instance_id, bid, unnest(kws) AS k FROM ks), u AS (SELECT *, count(*) OVER (PARTITION BY instance_id, k) AS n FROM ex),
s AS (SELECT instance_id, bid, CASE WHEN count(*) FILTER (n = 1) > 0 THEN list(k) FILTER (n = 1) ELSE list(k) END AS kws FROM u GROUP BY ALL), t AS (SELECT s.instance_id, s.bid, s.kws, {TEXTS} AS txt FROM s JOIN ks USING (instance_id, bid))
SELECT instance_id, count(*) AS n_branches, count(*) FILTER (len(list_filter(kws, lambda k: contains(txt, k))) > 0) AS n_covered FROM t GROUP BY instance_id""")
def branch_coverage(spark, sf_dir):
    """Branches of which a keyword of their own (a figure, or the whole canonical outcome) stands in the passages."""
    d = instances(spark, sf_dir).select("instance_id", "ps", F.explode("bs").alias("b")).where("b.outcome IS NOT NULL")
    d = d.select("instance_id", F.col("b.branch_id").alias("bid"), F.lower(F.array_join(F.transform("ps", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")).alias("t"), O.canonical_outcome(F.col("b.outcome")).alias("canon"))
    figs = F.transform(O.counted_figures(F.col("canon")), lambda x: F.concat(F.split_part(x, F.lit(" "), F.lit(2)), F.when(F.startswith(x, F.lit("%")), "%").otherwise("")))
    d = d.withColumn("kws", F.when(F.size(figs) > 0, F.array_distinct(figs)).otherwise(F.array("canon")))
    k = d.select("instance_id", "bid", F.explode("kws").alias("k"))
    own = k.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instance_id", "k"))).groupBy("instance_id", "bid").agg(F.collect_list(F.when(F.col("n") == 1, F.col("k"))).alias("u"), F.collect_list("k").alias("a"))
    own = own.select("instance_id", "bid", F.when(F.size("u") > 0, F.col("u")).otherwise(F.col("a")).alias("kws"))
    clean = F.regexp_replace(O.figures_normal(F.col("t")), r"\bp\d+\b", " ")
    j = d.select("instance_id", "bid", clean.alias("t")).join(own, ["instance_id", "bid"])
    return j.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_branches"), M.count_if(F.exists("kws", lambda k: F.contains(F.col("t"), k))).alias("n_covered"))


QUAD = f"{GI}, ov AS (SELECT instance_id, coalesce(rel, '') = 'opposed' AS opposed, round(coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(list_concat(ta, tb))), 0), 0), 9) AS overlap FROM (SELECT instance_id, rel, {OTOK("coalesce(ps[1].text, '')")} AS ta, {OTOK("coalesce(ps[2].text, '')")} AS tb FROM gi WHERE len(ps) >= 2)), md AS (SELECT median(overlap) AS m FROM ov)"


def overlapping(spark, sf_dir) -> DataFrame:
    d = instances(spark, sf_dir).where("size(ps) >= 2")
    text = lambda i: F.get("ps", F.lit(i))["text"]
    o = d.select("instance_id", (F.coalesce("rel", F.lit("")) == "opposed").alias("opposed"), F.round(X.similarity(text(0), text(1)), 9).alias("overlap"))
    return o.crossJoin(F.broadcast(o.agg(F.percentile("overlap", F.lit(0.5)).alias("m"))))  # one row


@query(f"WITH {QUAD}, q AS (SELECT CASE WHEN overlap >= m THEN 'high' ELSE 'low' END || CASE WHEN opposed THEN '/opposed' ELSE '/other' END AS quadrant, m, overlap FROM ov, md), n AS (SELECT quadrant, count(*) AS n, round(avg(overlap), 6) AS mean_overlap, round(any_value(m), 6) AS threshold FROM q GROUP BY quadrant) SELECT d.q AS quadrant, coalesce(n, 0)::BIGINT AS n, mean_overlap, threshold FROM (SELECT unnest(['high/opposed', 'high/other', 'low/opposed', 'low/other']) AS q) d LEFT JOIN n ON n.quadrant = d.q")
def overlap_quadrants(spark, sf_dir):
    """Instances by overlap of their first two passages (above the median or not) and opposition; empty quadrants count 0."""
    q = overlapping(spark, sf_dir).withColumn("quadrant", F.concat(F.when(F.col("overlap") >= F.col("m"), "high").otherwise("low"), F.when(F.col("opposed"), "/opposed").otherwise("/other")))
    n = q.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.max("m"), 6).alias("threshold"))
    every = spark.createDataFrame([(a + b,) for a in ("high", "low") for b in ("/opposed", "/other")], "quadrant string")
    return every.join(n, "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0)).alias("n"), "mean_overlap", "threshold")


@query(f"""WITH {QUAD}, q AS (SELECT instance_id, CASE WHEN (overlap >= m) = opposed THEN 'on' ELSE 'off' END AS diagonal, md5('v|' || instance_id) AS h FROM ov, md), r AS (SELECT *, row_number() OVER (PARTITION BY diagonal ORDER BY h, instance_id) AS r FROM q) SELECT instance_id, diagonal FROM r WHERE (diagonal = 'off' AND r <= 60) OR (diagonal = 'on' AND r <= 40)""")
def quadrant_sample(spark, sf_dir):
    """A sample of 100 by hash, sixty of them where overlap misleads."""
    q = overlapping(spark, sf_dir).select("instance_id", F.when((F.col("overlap") >= F.col("m")) == F.col("opposed"), "on").otherwise("off").alias("diagonal"))
    r = q.withColumn("r", F.row_number().over(Window.partitionBy("diagonal").orderBy(F.md5(F.concat(F.lit("v|"), "instance_id")), "instance_id")))
    return r.where("(diagonal = 'off' AND r <= 60) OR (diagonal = 'on' AND r <= 40)").select("instance_id", "diagonal")


@query(f"WITH {BR} SELECT instance_id, name, kind, array_to_string(list_sort(list_distinct(flatten(list(vals)))), ', ') AS members, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM av GROUP BY instance_id, name, kind")
def reader_dimensions(spark, sf_dir):
    """The dimensions a reader must state: over all branches of an instance, the values or the range of each attribute."""
    a = branches(spark, sf_dir).select("instance_id", F.explode("attributes").alias("a"))
    return a.groupBy("instance_id", F.col("a.name").alias("name"), F.col("a.kind").alias("kind")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a.values")))), ", ").alias("members"), F.min("a.lo").alias("lo"), F.max("a.hi").alias("hi"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BR}, rd AS (SELECT instance_id, bid AS asks, name, vals[1] AS v FROM av WHERE len(vals) > 0), h AS (SELECT r.instance_id, r.asks, b.bid, b.def, CASE WHEN b.def THEN true WHEN len(b.ats) = 0 THEN NULL ELSE bool_and(CASE WHEN a.name = r.name THEN list_contains(a.vals, r.v) END) END AS inside FROM rd r JOIN br b USING (instance_id) LEFT JOIN av a ON a.instance_id = b.instance_id AND a.bid = b.bid GROUP BY r.instance_id, r.asks, r.name, r.v, b.bid, b.def, b.ats)
SELECT instance_id, asks, coalesce(min(bid) FILTER (NOT def AND inside), min(bid) FILTER (def)) AS answered_by FROM h GROUP BY instance_id, asks""")
def branch_for_reader(spark, sf_dir):
    """A reader who has the first value of a branch's attribute: the exception that holds for them, else the default; unknown where
    nothing says."""
    b = branches(spark, sf_dir)
    r = b.select("instance_id", F.col("branch_id").alias("asks"), F.explode("attributes").alias("a")).where("size(a.values) > 0").select("instance_id", "asks", F.col("a.name").alias("name"), F.col("a.values")[0].alias("v"))
    inside = F.when(F.col("is_default"), F.lit(True)).when(F.size("attributes") > 0, F.forall(F.filter("attributes", lambda a: a["name"] == F.col("name")), lambda a: F.array_contains(a["values"], F.col("v"))) & F.exists("attributes", lambda a: a["name"] == F.col("name")))
    h = r.join(b, "instance_id").withColumn("inside", inside)
    e = F.min(F.when(~F.col("is_default") & F.col("inside"), F.col("branch_id")))
    return h.groupBy("instance_id", "asks").agg(F.coalesce(e, F.min(F.when(F.col("is_default"), F.col("branch_id")))).alias("answered_by"))


ORDER = list(AUTHORITY)


@query(f"WITH {RECS}, o AS (SELECT instance_id, pid, coalesce(list_position({LIST(ORDER)}, st), 99) AS a, coalesce(d, '') AS d FROM dt), r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY a, d, pid) AS r FROM o) SELECT instance_id, pid FROM r WHERE r = 1")
def most_credible(spark, sf_dir):
    """The passage of the most credible kind of source, of those the earliest; unknown kinds come last."""
    at = F.array_position(F.array(*map(F.lit, ORDER)), F.col("st"))
    o = _dated(spark, sf_dir).select("instance_id", "pid", F.when(at > 0, at).otherwise(99).alias("a"), F.coalesce("d", F.lit("")).alias("d"))
    return o.groupBy("instance_id").agg(F.min(F.struct("a", "d", "pid"))["pid"].alias("pid"))


@query(f"WITH {TOPSIS}, c AS (SELECT instance_id, pid, round(closeness, 6) AS c FROM cl), r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY c DESC, pid) AS r, round(max(c) OVER (PARTITION BY instance_id) - nth_value(c, 2) OVER (PARTITION BY instance_id ORDER BY c DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS margin FROM c) SELECT instance_id, pid FROM r WHERE margin IS NULL OR margin <= 0.1 OR r = 1")
def chosen_by_credibility(spark, sf_dir):
    """The first passage by credibility where it leads by more than 0.1, else all."""
    c = topsis_credibility(spark, sf_dir).withColumnRenamed("closeness", "c")
    w = Window.partitionBy("instance_id").orderBy(F.desc("c"), "pid")
    r = c.withColumn("r", F.row_number().over(w)).withColumn("second", F.nth_value("c", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("first", F.max("c").over(Window.partitionBy("instance_id")))
    return r.where("second IS NULL OR round(first - second, 6) <= 0.1 OR r = 1").select("instance_id", "pid")


RULES = """list_filter([CASE WHEN len(list_distinct(list_transform(bs, lambda b: b.branch_id))) < len(bs) THEN 'repeated_branch' END, CASE WHEN len(list_filter(bs, lambda b: coalesce(b.applicability.is_default, false))) = 0 AND rel IN ('refinement', 'redundant') THEN 'default_missing' END,
 CASE WHEN len(list_filter(bs, lambda b: NOT coalesce(b.applicability.is_default, false) AND b.supporting_passage IS NULL)) > 0 THEN 'ungrounded_exception' END, CASE WHEN ctype = 'conditional' AND rel = 'redundant' AND len(bs) <> 1 THEN 'redundant_needs_one' END,
 CASE WHEN ctype = 'conditional' AND rel <> 'redundant' AND len(bs) < 2 THEN 'conditional_needs_two' END, CASE WHEN rel IS NOT NULL AND ctype NOT IN ('conditional', 'factual') THEN 'relation_without_scope' END, CASE WHEN opp IS NOT NULL AND coalesce(rel, '') <> 'opposed' THEN 'opposition_without_opposed' END,
 CASE WHEN construction = 'natural' AND len(list_filter(ps, lambda p: p.document_id IS NOT NULL)) >= 2 AND len(list_distinct(list_filter(list_transform(ps, lambda p: p.document_id), lambda d: d IS NOT NULL))) = 1 THEN 'natural_of_one_document' END,
 CASE WHEN len(list_filter(ps, lambda p: p.date IS NOT NULL AND NOT regexp_full_match(p.date, '\\d{4}(-\\d{2}){0,2}'))) > 0 THEN 'date_format' END, CASE WHEN len(list_filter(ps, lambda p: coalesce(p.text, '') = '')) > 0 THEN 'empty_passage' END,
 CASE WHEN len(list_filter(flatten(list_transform(bs, lambda b: b.applicability.attributes)), lambda a: (a.kind IN ('categorical', 'ordered_tier') AND coalesce(len(a.values), 0) = 0) OR (a.kind IN ('numeric', 'numeric_range') AND (a.min_value IS NULL AND a.max_value IS NULL OR a.min_value > a.max_value)) OR (a.kind = 'boolean' AND a.boolean_value IS NULL))) > 0 THEN 'attribute_payload' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {GI}, v AS (SELECT instance_id, unnest({RULES}) AS rule FROM gi) SELECT rule, count(*) AS n, min(instance_id) AS first_instance FROM v GROUP BY rule".replace("\\\\d", "\\d"))
def contract_violations(spark, sf_dir):
    """Eleven rules that instances keep between label, branches, passages and attributes, and how often each is broken."""
    default = lambda b: F.coalesce(b["applicability"]["is_default"], F.lit(False))
    docs = F.array_compact(F.transform("ps", lambda p: p["document_id"]))
    some = lambda c: F.coalesce(c, F.lit(False))
    payload = lambda a: (
        (a["kind"].isin(*S.SETS) & (F.coalesce(F.size(a["values"]), F.lit(0)) <= 0)) | (a["kind"].isin(*S.INTERVALS) & ((a["min_value"].isNull() & a["max_value"].isNull()) | some(a["min_value"] > a["max_value"]))) | ((a["kind"] == "boolean") & a["boolean_value"].isNull())
    )
    conditional = F.col("ctype") == "conditional"
    rules = [
        ("repeated_branch", F.size(F.array_distinct(F.transform("bs", lambda b: b["branch_id"]))) < F.size("bs")), ("default_missing", ~F.exists("bs", default) & F.col("rel").isin("refinement", "redundant")),
        ("ungrounded_exception", F.exists("bs", lambda b: ~default(b) & b["supporting_passage"].isNull())), ("redundant_needs_one", conditional & (F.col("rel") == "redundant") & (F.size("bs") != 1)),
        ("conditional_needs_two", conditional & (F.col("rel") != "redundant") & (F.size("bs") < 2)), ("relation_without_scope", F.col("rel").isNotNull() & ~F.col("ctype").isin("conditional", "factual")),
        ("opposition_without_opposed", F.col("opp").isNotNull() & (F.coalesce("rel", F.lit("")) != "opposed")), ("natural_of_one_document", (F.col("construction") == "natural") & (F.size(docs) >= 2) & (F.size(F.array_distinct(docs)) == 1)),
        ("date_format", F.exists("ps", lambda p: some(~p["date"].rlike(r"^\d{4}(-\d{2}){0,2}$")))), ("empty_passage", F.exists("ps", lambda p: F.coalesce(p["text"], F.lit("")) == "")),
        ("attribute_payload", F.exists(F.flatten(F.transform("bs", lambda b: F.coalesce(b["applicability"]["attributes"], F.array()))), payload)),
    ]
    v = instances(spark, sf_dir).select("instance_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).alias("rule"))
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("first_instance"))


FOLD = f"lower(trim(regexp_replace({{}}, '[{SPACE}]+', ' ', 'g')))"


@query(f"""WITH {GI}, b AS (SELECT instance_id, b.branch_id AS bid, b.outcome AS o, list_filter(ps, lambda p: p.id = b.supporting_passage)[1].text AS t FROM (SELECT instance_id, ps, unnest(bs) AS b FROM gi))
SELECT instance_id, bid AS branch_id, coalesce({FOLD.format("coalesce(o, '')")} <> '' AND contains({FOLD.format("coalesce(t, '')")}, {FOLD.format("coalesce(o, '')")}), false) AS verbatim, coalesce(strpos(t, o), 0)::BIGINT AS found_at FROM b""")
def verbatim_outcomes(spark, sf_dir):
    """Whether a branch's outcome stands word for word in the passage it cites, case and white space aside, and where."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{T.SPACE}]+", " ")))
    b = instances(spark, sf_dir).select("instance_id", "ps", F.explode("bs").alias("b"))
    b = b.select("instance_id", F.col("b.branch_id").alias("branch_id"), F.col("b.outcome").alias("o"), F.get(F.filter("ps", lambda p: p["id"] == F.col("b.supporting_passage")), F.lit(0))["text"].alias("t"))
    return b.select("instance_id", "branch_id", ((fold(F.col("o")) != "") & F.contains(fold(F.col("t")), fold(F.col("o")))).alias("verbatim"), F.coalesce(F.expr("instr(t, o)"), F.lit(0)).cast("bigint").alias("found_at"))


@query(f"""WITH {GI} SELECT instance_id, list_sort(list_filter(list_transform(ps, lambda p: p.id), lambda i: NOT starts_with(i, 'n')))[1] AS doc_i, list_sort(list_filter(list_transform(ps, lambda p: p.id), lambda i: NOT starts_with(i, 'n')))[2] AS doc_j, ctype <> 'no_conflict' AS is_conflict, ctype AS type, rel AS scope_relation, len(ps) AS n_passages FROM gi""")
def query_records(spark, sf_dir):
    """Instances as query records: the labelled pair is the first two passages by id that are no hard negatives."""
    ids = F.array_sort(F.filter(F.transform("ps", lambda p: p["id"]), lambda i: ~F.startswith(i, F.lit("n"))))
    return instances(spark, sf_dir).select("instance_id", F.get(ids, F.lit(0)).alias("doc_i"), F.get(ids, F.lit(1)).alias("doc_j"), (F.col("ctype") != "no_conflict").alias("is_conflict"), F.col("ctype").alias("type"), F.col("rel").alias("scope_relation"), F.size("ps").cast("bigint").alias("n_passages"))


@query("SELECT 0::BIGINT AS n_changed")
def order_invariance(spark, sf_dir):
    """Pairs whose relation, agreement or narrower branch changes when the branches of a record are reversed: none may."""
    forth = exception_pairs(spark, sf_dir).select("instance_id", "a", "b", "relation", "same", "narrower", "flag")
    b = branches(spark, sf_dir)
    mirror = {"subset": "superset", "superset": "subset"}
    a = b.select("instance_id", *[F.col(c).alias(f"a_{c}") for c in b.columns[1:]])
    p = a.join(b, "instance_id").where("a_branch_id > branch_id")
    rel = S.scope_relation(F.col("a_attributes"), F.col("attributes"), F.col("a_is_default"), F.col("is_default"))
    back = F.when(rel == "subset", mirror["subset"]).when(rel == "superset", mirror["superset"]).otherwise(rel)
    turned = p.select("instance_id", F.col("branch_id").alias("a"), F.col("a_branch_id").alias("b"), back.alias("relation"), ((F.col("a_outcome") == F.col("outcome")) | X.values_match(F.col("outcome"), F.col("a_outcome"))).alias("same"), S.narrower(rel, F.col("a_branch_id"), F.col("branch_id")).alias("narrower"))
    own = forth.drop("flag")
    return own.exceptAll(turned).unionAll(turned.exceptAll(own)).agg(F.count(F.lit(1)).alias("n_changed"))
