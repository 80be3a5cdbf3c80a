"""Pairs of passages and of sentences."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import pairs as P
from quernstone.queries._registry import family
from quernstone.queries.text import ELEMENTS, WORDS, elements
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()


def gold(spark, sf_dir) -> DataFrame:
    """One row for each instance; repeated rows are equal."""
    return table(spark, sf_dir, "gold_instances").dropDuplicates(["instance_id"])


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))"
CUES = lambda col, cues: "(" + " + ".join(f"contains(lower({col}), '{c}')::BIGINT" for c in cues) + ")"
FIGS = r"list_distinct(list_transform(regexp_extract_all(regexp_replace({}, '(\d),(\d{{3}})', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda x: regexp_replace(regexp_replace(x, '(\.\d*[1-9])0+$', '\1'), '\.0+$', '')))"
WC = f"greatest(1, {WORDS})"
WSET = "list_distinct(regexp_extract_all(lower({}), '[a-z'']+'))"
NUMS = r"list_distinct(list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)?\s*%?'), lambda x: rtrim(x)))"
YEARS = r"list_distinct(regexp_extract_all({}, '\b(?:19|20)\d{{2}}\b'))"
FIGP = r"list_distinct(regexp_extract_all({}, '\d+(?:\.\d+)?%?'))"
QUAL = lambda c: f"({CUES(c, T.EXCEPTION_CUES)} + {CUES(c, T.CONDITION_CUES)} + {CUES(c, T.RESTRICTION_CUES)} + len(regexp_extract_all(lower({c}), '" + T.MODALS.replace("'", "''") + f"')) + len({c}) - len(replace({c}, ',', '')))"
CLASH = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"
JAC = lambda a, b: f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"
PAIRS = rf"""g AS (SELECT instance_id, any_value(passages) AS p FROM gold_instances GROUP BY instance_id), u AS (SELECT instance_id, unnest(p) AS x, unnest(range(len(p))) AS pos FROM g),
pr AS (SELECT a.instance_id, a.x.id AS doc_i, b.x.id AS doc_j, coalesce(a.x.text, '') AS ti, coalesce(b.x.text, '') AS tj FROM u a JOIN u b ON a.instance_id = b.instance_id AND a.x.id < b.x.id),
k AS (SELECT *, {WSET.format('ti')} AS ca, {WSET.format('tj')} AS cb, {NUMS.format('ti')} AS fa, {NUMS.format('tj')} AS fb, {YEARS.format('ti')} AS ya, {YEARS.format('tj')} AS yb,
 {CUES('ti', T.EXCEPTION_CUES)} AS exception_cues_i, {CUES('tj', T.EXCEPTION_CUES)} AS exception_cues_j, {CUES('ti', T.RESTRICTION_CUES)} AS restriction_cues_i, {CUES('tj', T.RESTRICTION_CUES)} AS restriction_cues_j,
 {QUAL('ti')} AS qualifiers_i, {QUAL('tj')} AS qualifiers_j, {FIGP.format('ti')} AS ga, {FIGP.format('tj')} AS gb FROM pr),
f AS (SELECT *, greatest(exception_cues_i, exception_cues_j) AS exception_cues_max, abs(exception_cues_i - exception_cues_j) AS exception_cues_asymmetry, abs(restriction_cues_i - restriction_cues_j) AS restriction_asymmetry,
 abs(qualifiers_i - qualifiers_j) AS specificity_asymmetry, round(least({WC.format('ti')}, {WC.format('tj')}) / greatest({WC.format('ti')}, {WC.format('tj')}), 9) AS length_ratio,
 round({JAC('fa', 'fb')}, 9) AS numeric_overlap, {CLASH('fa', 'fb')}::BIGINT AS numeric_clash, (len(ya) > 0 AND len(yb) > 0 AND list_sort(ya) <> list_sort(yb))::BIGINT AS year_clash,
 greatest({CUES('ti', T.TEMPORAL_CUES)}, {CUES('tj', T.TEMPORAL_CUES)}) AS temporal_cues_max, greatest({CUES('ti', T.OPINION_CUES)}, {CUES('tj', T.OPINION_CUES)}) AS opinion_cues_max, round({JAC('ca', 'cb')}, 9) AS token_jaccard FROM k)"""
FEATURES = """exception_cues_i exception_cues_j exception_cues_max exception_cues_asymmetry restriction_cues_i restriction_cues_j restriction_asymmetry qualifiers_i qualifiers_j
specificity_asymmetry length_ratio numeric_overlap numeric_clash year_clash temporal_cues_max opinion_cues_max token_jaccard""".split()
ROUNDED = ("length_ratio", "numeric_overlap", "token_jaccard")


def _featured(spark, sf_dir):
    p = P.passage_pairs(gold(spark, sf_dir))
    return p.select("*", *[c.alias(n) for n, c in P.features(F.col("text_i"), F.col("text_j")).items()])


@query(f"WITH {PAIRS} SELECT instance_id, doc_i, doc_j, {', '.join(f'round({c}, 6) AS {c}' if c in ROUNDED else c for c in FEATURES)} FROM f")
def pair_features(spark, sf_dir):
    """Seventeen lexical features of every two passages of an instance."""
    f = _featured(spark, sf_dir)
    return f.select("instance_id", "doc_i", "doc_j", *[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in FEATURES])


NEGS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in P.NEGATIONS) + "]"
NLI = f"""{PAIRS}, nv AS (SELECT *, CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN 'blank' WHEN {CLASH('ga', 'gb')} AND ov > 0.3 THEN 'figures' WHEN list_has_any(ca, {NEGS}) <> list_has_any(cb, {NEGS}) AND ov > 0.3 THEN 'polarity' WHEN ov > 0.7 THEN 'covered' WHEN ov > 0.35 THEN 'related' ELSE 'unrelated' END AS kind
 FROM (SELECT *, coalesce(len(list_intersect(ca, cb)) / nullif(len(cb), 0), 0) AS ov FROM f)),
nl AS (SELECT *, CASE kind WHEN 'blank' THEN 0.0 WHEN 'figures' THEN 0.80 WHEN 'polarity' THEN 0.65 WHEN 'related' THEN 0.10 ELSE 0.05 END AS con, CASE kind WHEN 'blank' THEN 1.0 WHEN 'figures' THEN 0.15 WHEN 'polarity' THEN 0.25 WHEN 'covered' THEN 0.20 WHEN 'related' THEN 0.65 ELSE 0.90 END AS neu FROM nv),
rs AS (SELECT *, round(greatest(0, least(1, (0.6 * (con + 0.25 * neu) + 0.2 * least(1, exception_cues_max / 2) + 0.1 * least(1, restriction_asymmetry / 2) + 0.15 * numeric_clash + 0.1 * year_clash) * (0.35 + 0.65 * least(1, 3 * token_jaccard)))), 6) AS score FROM nl)"""


def _ruled(spark, sf_dir):
    f = _featured(spark, sf_dir).withColumn("nli", P.heuristic_entailment(F.col("text_i"), F.col("text_j")))
    return f.withColumn("score", F.round(P.rule_score(F.col("nli"), {c: F.col(c) for c in f.columns}), 6))


REL = "CASE WHEN token_jaccard < 0.2 THEN 'disjoint' WHEN numeric_clash = 0 AND exception_cues_max = 0 THEN 'redundant' WHEN restriction_asymmetry >= 1 OR specificity_asymmetry >= 2 THEN 'refinement' ELSE 'opposed' END"


@query(f"""WITH {PAIRS}, t AS (SELECT instance_id, doc_i, doc_j, CASE WHEN temporal_cues_max >= 1 AND (year_clash > 0 OR numeric_clash > 0) THEN 'temporal' WHEN opinion_cues_max >= 1 THEN 'opinion'
 WHEN exception_cues_max >= 1 OR (restriction_asymmetry >= 1 AND specificity_asymmetry >= 1) THEN 'conditional' WHEN numeric_clash > 0 OR token_jaccard > 0.45 THEN 'factual' ELSE 'no_conflict' END AS conflict_type, {REL} AS r FROM f)
SELECT instance_id, doc_i, doc_j, conflict_type, CASE WHEN conflict_type = 'conditional' THEN r END AS scope_relation FROM t""")
def rule_labels(spark, sf_dir):
    """Conflict type, and the scope relation of conditional pairs, by surface rules."""
    f = _featured(spark, sf_dir)
    cols = {c: F.col(c) for c in FEATURES}
    t = f.select("instance_id", "doc_i", "doc_j", P.rule_type(cols).alias("conflict_type"), P.rule_relation(cols).alias("r"))
    return t.select("instance_id", "doc_i", "doc_j", "conflict_type", F.when(F.col("conflict_type") == "conditional", F.col("r")).alias("scope_relation"))


@query(f"WITH {PAIRS} SELECT instance_id, doc_i, doc_j, sign(qualifiers_j - qualifiers_i)::BIGINT AS narrower FROM f")
def more_specific(spark, sf_dir):
    """Which passage is the more qualified: -1 the first, 1 the second, 0 neither."""
    return _featured(spark, sf_dir).select("instance_id", "doc_i", "doc_j", F.signum(F.col("qualifiers_j") - F.col("qualifiers_i")).cast("bigint").alias("narrower"))


@query(f"WITH {NLI} SELECT instance_id, doc_i, doc_j, con::DOUBLE AS contradiction, score::DOUBLE AS score, score >= 0.5 AS conflict, score BETWEEN 0.35 AND 0.75 AS escalate FROM rs")
def rule_scores(spark, sf_dir):
    """First-stage conflict score of each pair, and whether it goes to a second stage."""
    return _ruled(spark, sf_dir).select("instance_id", "doc_i", "doc_j", F.col("nli.contradiction").alias("contradiction"), "score", (F.col("score") >= 0.5).alias("conflict"), F.col("score").between(0.35, 0.75).alias("escalate"))


@query(f"""WITH {NLI}, b AS (SELECT unnest(range(11)) AS i), w AS (SELECT i, 0.5 - i * 0.05 AS low, 0.5 + i * 0.05 AS high FROM b)
SELECT i::BIGINT AS band, count(*) AS n_pairs, count(*) FILTER (score >= round(low, 2) AND score <= round(high, 2)) AS n_escalated FROM rs, w GROUP BY i""")
def escalation_bands(spark, sf_dir):
    """Pairs inside each of eleven bands around one half: one pass, the grid is a small array."""
    s = _ruled(spark, sf_dir).select("score", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    inside = (F.col("score") >= F.round(0.5 - F.col("i") * 0.05, 2)) & (F.col("score") <= F.round(0.5 + F.col("i") * 0.05, 2))
    return s.groupBy(F.col("i").cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(inside.cast("bigint")).alias("n_escalated"))


@query(f"""WITH {NLI}, o AS (SELECT instance_id, max(score) AS score FROM rs GROUP BY instance_id), t AS (SELECT o.*, gi.t AS gold FROM o JOIN (SELECT instance_id, any_value(gold_conflict_type) AS t FROM gold_instances GROUP BY 1) gi USING (instance_id))
SELECT gold AS gold_conflict_type, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 0.5) AS n_detected FROM t GROUP BY gold""")
def detection_by_type(spark, sf_dir):
    """The strongest pair of an instance against its gold type."""
    best = _ruled(spark, sf_dir).groupBy("instance_id").agg(F.max("score").alias("score"))
    g = gold(spark, sf_dir).select("instance_id", "gold_conflict_type")
    return best.join(g, "instance_id").groupBy("gold_conflict_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum((F.col("score") >= 0.5).cast("bigint")).alias("n_detected"))


@query(f"""WITH q AS (SELECT DISTINCT question FROM questions), s AS (SELECT question AS k, list_sort({CONTENT.format('question')}) AS t FROM q), c AS (SELECT t, k FROM s WHERE len(t) > 0),
p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.t, b.t)) AS common, len(a.t) AS na, len(b.t) AS nb FROM c a JOIN c b ON a.k < b.k)
SELECT a, b, common, round(common / (na + nb - common), 6) AS jaccard FROM p WHERE common / (na + nb - common) >= 0.8""")
def similar_questions(spark, sf_dir):
    """All pairs of questions whose content words have a Jaccard of 0.8 or more, by prefix-filtered join; those with equal content words too."""
    q = table(spark, sf_dir, "questions").select("question").distinct()
    return P.similar_sets(q.select("question", T.content_tokens(F.col("question")).alias("t")), "question", "t", 0.8, copies=True)


@query(rf"""WITH n AS (SELECT instance_id, unnest(p) AS x FROM (SELECT instance_id, any_value(passages) AS p FROM gold_instances GROUP BY 1)), t AS (SELECT instance_id, x.id AS pid, array_to_string(regexp_extract_all(lower(coalesce(x.text, '')), '[a-z0-9]+'), ' ') AS norm FROM n)
SELECT md5(norm) AS passage_md5, count(*) AS n_passages, count(DISTINCT instance_id) AS n_instances FROM t GROUP BY norm HAVING count(*) > 1""")
def repeated_passages(spark, sf_dir):
    """Passages that stand in more than one place, in normal form."""
    p = gold(spark, sf_dir).select("instance_id", F.explode("passages.text").alias("t"))
    norm = F.array_join(T.tokens(F.coalesce("t", F.lit(""))), " ")
    return p.groupBy(F.md5(norm).alias("passage_md5")).agg(F.count(F.lit(1)).alias("n_passages"), F.count_distinct("instance_id").alias("n_instances")).where("n_passages > 1")


RULES = ["must", "pays", "can", "may"]


@query(f"""WITH {ELEMENTS}, s AS (SELECT doc, pos, txt, {CUES('txt', T.EXCEPTION_CUES)} > 0 AS exc, regexp_matches(lower(txt), '\\b(must|pays|can|may)\\b') AS rule, {CONTENT.format('txt')} AS t FROM el WHERE length(txt) >= 30),
p AS (SELECT r.doc, r.pos AS rule_pos, e.pos AS exception_pos, round(len(list_intersect(r.t, e.t)) / len(list_distinct(list_concat(r.t, e.t))), 9) AS overlap FROM s r JOIN s e ON r.doc = e.doc AND r.pos <> e.pos AND r.rule AND NOT r.exc AND e.exc),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, rule_pos ORDER BY overlap DESC, exception_pos) AS rank FROM p WHERE overlap >= 0.18)
SELECT doc, rule_pos, exception_pos, round(overlap, 6) AS overlap, rank FROM k WHERE rank <= 2""")
def mine_rule_exceptions(spark, sf_dir):
    """For each rule of a page, the two sentences stating an exception on the same topic."""
    e = elements(spark, sf_dir).where(F.length("txt") >= 30)
    e = e.select("doc", "pos", (T.cue_count(F.col("txt"), T.EXCEPTION_CUES) > 0).alias("exc"), F.lower("txt").rlike(r"\b(must|pays|can|may)\b").alias("rule"), T.content_tokens(F.col("txt")).alias("t"))
    r = e.where("rule AND NOT exc").select("doc", F.col("pos").alias("rule_pos"), F.col("t").alias("rt"))
    x = e.where("exc").select("doc", F.col("pos").alias("exception_pos"), F.col("t").alias("xt"))
    p = r.join(x, "doc").where("rule_pos <> exception_pos").withColumn("overlap", F.round(T.jaccard(F.col("rt"), F.col("xt")), 9)).where("overlap >= 0.18")
    w = Window.partitionBy("doc", "rule_pos").orderBy(F.desc("overlap"), "exception_pos")
    return p.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 2").select("doc", "rule_pos", "exception_pos", F.round("overlap", 6).alias("overlap"), "rank")


RECS = r"""rc AS (SELECT instance_id, x.id AS pid, coalesce(x.text, '') AS t, x.date AS d, x.source_type AS st FROM (SELECT instance_id, unnest(p) AS x FROM (SELECT instance_id, any_value(passages) AS p FROM gold_instances GROUP BY 1))),
dt AS (SELECT *, CASE WHEN d IS NOT NULL THEN make_date(substr(d, 1, 4)::INT, coalesce(nullif(substr(d, 6, 2), ''), '1')::INT, coalesce(nullif(substr(d, 9, 2), ''), '1')::INT) END AS day FROM rc)"""


def _dated(spark, sf_dir):
    p = gold(spark, sf_dir).select("instance_id", F.explode("passages").alias("x")).select("instance_id", F.col("x.id").alias("pid"), F.coalesce("x.text", F.lit("")).alias("t"), F.col("x.date").alias("d"), F.col("x.source_type").alias("st"))
    part = lambda i, n: F.coalesce(F.try_to_number(F.substring("d", i, n), F.lit("9" * n)).cast("int"), F.lit(1))
    return p.withColumn("day", F.when(F.col("d").isNotNull(), F.make_date(part(1, 4), part(6, 2), part(9, 2))))


@query(f"WITH {RECS}, r AS (SELECT instance_id, pid, day, rank() OVER (PARTITION BY instance_id ORDER BY day DESC) AS r FROM dt WHERE day IS NOT NULL) SELECT instance_id, pid, strftime(day, '%Y-%m-%d') AS day FROM r WHERE r = 1")
def newest_passages(spark, sf_dir):
    """The newest passages of each instance, partial dates completed; ties stay, undated passages never win."""
    w = Window.partitionBy("instance_id").orderBy(F.desc("day"))
    return _dated(spark, sf_dir).where("day IS NOT NULL").withColumn("r", F.rank().over(w)).where("r = 1").select("instance_id", "pid", F.date_format("day", "yyyy-MM-dd").alias("day"))


AUTHORITY = {"government_guidance": 4.0, "product_terms": 3.0, "category_page": 2.0, "third_party": 1.0}
TOPSIS = f"""{RECS}, k AS (SELECT instance_id, pid, CASE st {' '.join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY.items())} ELSE 0.5 END AS a,
 CASE WHEN day IS NULL THEN 0.0 WHEN max(day) OVER w = min(day) OVER w THEN 1.0 ELSE (day - min(day) OVER w)::DOUBLE / (max(day) OVER w - min(day) OVER w) END AS r, (len({FIGS.format('t')}) + 1.5 * {CUES('t', T.EXCEPTION_CUES)}) / (len({FIGS.format('t')}) + 1.5 * {CUES('t', T.EXCEPTION_CUES)} + 4) AS s FROM dt WINDOW w AS (PARTITION BY instance_id)),
l AS (SELECT instance_id, pid, c, x::DOUBLE AS x, count(*) OVER w AS m, sum(x::DOUBLE) OVER w AS sx, sqrt(sum(x::DOUBLE * x) OVER w) AS nx FROM (UNPIVOT k ON a, r, s INTO NAME c VALUE x) WINDOW w AS (PARTITION BY instance_id, c)),
e AS (SELECT instance_id, c, greatest(0, 1 + sum(CASE WHEN x > 0 THEN x / sx * ln(x / sx) ELSE 0 END) / ln(any_value(m))) AS d FROM l WHERE m > 1 AND sx > 0 GROUP BY ALL),
wt AS (SELECT instance_id, c, CASE WHEN sum(d) OVER (PARTITION BY instance_id) <= 1e-12 THEN 1.0 / count(*) OVER (PARTITION BY instance_id) ELSE d / sum(d) OVER (PARTITION BY instance_id) END AS w FROM e),
v AS (SELECT instance_id, pid, c, w * x / nx AS v FROM l JOIN wt USING (instance_id, c)), b AS (SELECT instance_id, pid, v - max(v) OVER z AS p, v - min(v) OVER z AS n FROM v WINDOW z AS (PARTITION BY instance_id, c)),
cl AS (SELECT instance_id, pid, CASE WHEN sqrt(sum(p * p)) + sqrt(sum(n * n)) <= 1e-12 THEN 0.5 ELSE sqrt(sum(n * n)) / (sqrt(sum(p * p)) + sqrt(sum(n * n))) END AS closeness FROM b GROUP BY ALL)"""


@query(f"WITH {TOPSIS} SELECT instance_id, pid, round(closeness, 6) AS closeness FROM cl")
def topsis_credibility(spark, sf_dir):
    """Closeness of each passage to the ideal by authority, recency and specificity, weighted by entropy."""
    rec = Window.partitionBy("instance_id")
    days = lambda c: F.unix_date(c)
    lo, hi = F.min(days("day")).over(rec), F.max(days("day")).over(rec)
    spec = F.size(T.figures(F.col("t"))) + 1.5 * T.cue_count(F.col("t"), T.EXCEPTION_CUES)
    authority = F.lit(0.5)
    for k, v in AUTHORITY.items():
        authority = F.when(F.col("st") == k, v).otherwise(authority)
    k = _dated(spark, sf_dir).select("instance_id", "pid", authority.alias("a"), F.when(F.col("day").isNull(), 0.0).when(hi == lo, 1.0).otherwise((days("day") - lo) / (hi - lo)).alias("r"), (spec / (spec + 4)).alias("s"))
    long = k.unpivot(["instance_id", "pid"], ["a", "r", "s"], "c", "x")
    col = Window.partitionBy("instance_id", "c")
    l = long.withColumn("m", F.count(F.lit(1)).over(col)).withColumn("sx", F.sum("x").over(col)).withColumn("nx", F.sqrt(F.sum(F.col("x") * F.col("x")).over(col))).where("m > 1 AND sx > 0")
    share = F.col("x") / F.col("sx")
    e = F.sum(F.when(F.col("x") > 0, share * F.log(share)).otherwise(0.0)).over(col) / F.log("m")
    l = l.withColumn("d", F.greatest(F.lit(0.0), 1 + e))
    total, n = F.sum(F.col("d") / F.col("m")).over(rec), F.sum(1 / F.col("m")).over(rec)  # a column counts once, not once a passage
    l = l.withColumn("v", F.when(total <= 1e-12, 1 / n).otherwise(F.col("d") / total) * F.col("x") / F.col("nx"))
    l = l.withColumn("p", F.col("v") - F.max("v").over(col)).withColumn("q", F.col("v") - F.min("v").over(col))
    away = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return l.groupBy("instance_id", "pid").agg(F.round(F.when(away("p") + away("q") <= 1e-12, 0.5).otherwise(away("q") / (away("p") + away("q"))), 6).alias("closeness"))


CONTRA = f"""{PAIRS}, od AS (SELECT a.instance_id, a.x.id AS i, b.x.id AS j, a.pos AS pi, b.pos AS pj, {WSET.format("coalesce(a.x.text, '')")} AS ca, {WSET.format("coalesce(b.x.text, '')")} AS cb, {FIGP.format("coalesce(a.x.text, '')")} AS ga, {FIGP.format("coalesce(b.x.text, '')")} AS gb FROM u a JOIN u b ON a.instance_id = b.instance_id AND a.pos <> b.pos),
mx AS (SELECT *, CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN 0.0 WHEN {CLASH('ga', 'gb')} AND ov > 0.3 THEN 0.80 WHEN list_has_any(ca, {NEGS}) <> list_has_any(cb, {NEGS}) AND ov > 0.3 THEN 0.65 WHEN ov > 0.7 THEN 0.05 WHEN ov > 0.35 THEN 0.10 ELSE 0.05 END AS con FROM (SELECT *, coalesce(len(list_intersect(ca, cb)) / nullif(len(cb), 0), 0) AS ov FROM od))"""


def _matrix(spark, sf_dir):
    """(instance_id, i, j, pi, pj, con): the contradiction of every ordered pair of passages, made inside each record's array."""
    p = gold(spark, sf_dir).select("instance_id", F.posexplode("passages").alias("pi", "a"), "passages").select("instance_id", "pi", "a", F.posexplode("passages").alias("pj", "b")).where("pi <> pj")
    text = lambda c: F.coalesce(F.col(f"{c}.text"), F.lit(""))
    return p.select("instance_id", F.col("a.id").alias("i"), F.col("b.id").alias("j"), "pi", "pj", P.heuristic_entailment(text("a"), text("b"))["contradiction"].alias("con"))


@query(f"WITH {CONTRA} SELECT instance_id, i, j, con::DOUBLE AS con FROM mx")
def contradiction_matrix(spark, sf_dir):
    """Contradiction of each passage by each other, as the lexical stand-in scores it."""
    return _matrix(spark, sf_dir).select("instance_id", "i", "j", "con")


@query(f"""WITH RECURSIVE {CONTRA}, cn AS (SELECT instance_id, least(i, j) AS a, greatest(i, j) AS b FROM mx GROUP BY ALL HAVING max(con) >= 0.5), o AS (SELECT instance_id, x.id AS id, pos + 1 AS i FROM u),
al(instance_id, i, kept) AS (SELECT instance_id, 0::BIGINT, []::VARCHAR[] FROM g
 UNION ALL SELECT o.instance_id, o.i, CASE WHEN EXISTS (SELECT 1 FROM cn WHERE cn.instance_id = o.instance_id AND ((cn.b = o.id AND list_contains(al.kept, cn.a)) OR (cn.a = o.id AND list_contains(al.kept, cn.b)))) THEN al.kept ELSE list_append(al.kept, o.id) END FROM al JOIN o ON o.instance_id = al.instance_id AND o.i = al.i + 1)
SELECT instance_id, array_to_string(arg_max(kept, i), ' ') AS kept FROM al GROUP BY instance_id""")
def contradiction_filter(spark, sf_dir):
    """Passages in rank order; one that contradicts, in either direction, an earlier one still kept is dropped."""
    pair = F.concat_ws("|", F.least("i", "j"), F.greatest("i", "j"))
    cn = _matrix(spark, sf_dir).where("con >= 0.5").groupBy("instance_id").agg(F.collect_set(pair).alias("cn"))  # pairs of one record
    d = gold(spark, sf_dir).select("instance_id", F.col("passages.id").alias("ids")).join(cn, "instance_id", "left")
    known = F.coalesce("cn", F.array().cast("array<string>"))
    return d.select("instance_id", F.array_join(P.alive_in_order(F.col("ids"), lambda i, j: F.array_contains(known, F.concat_ws("|", F.least(i, j), F.greatest(i, j)))), " ").alias("kept"))


@query(f"""WITH {CONTRA}, t AS (SELECT instance_id, j AS id, round(sum(con), 6) AS total FROM mx GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY total DESC, id DESC) AS r FROM t) SELECT instance_id, id AS dropped, total::DOUBLE AS total FROM r WHERE r = 1 AND total >= 0.5""")
def odd_one_out(spark, sf_dir):
    """The one passage the others contradict most, where they do so by one half or more; of equal ones the greater id."""
    t = _matrix(spark, sf_dir).groupBy("instance_id", F.col("j").alias("id")).agg(F.round(F.sum("con"), 6).alias("total"))
    worst = t.groupBy("instance_id").agg(F.max(F.struct("total", "id")).alias("w")).where("w.total >= 0.5")
    return worst.select("instance_id", F.col("w.id").alias("dropped"), F.col("w.total").alias("total"))
