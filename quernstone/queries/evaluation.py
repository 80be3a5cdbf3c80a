"""Evaluation metrics and inference over result cells, annotation passes and gold instances."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import inference as I
from quernstone.operators import metrics as M
from quernstone.queries._registry import family
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()

Q = """q AS (SELECT qid, any_value(doc) AS doc, any_value(answers) AS gold, any_value(not_answerable) AS na FROM questions GROUP BY qid),
c AS (SELECT cell_id, any_value(qid) AS qid, any_value(system) AS system, any_value(model) AS model, any_value(answers) AS answers, any_value(ok) AS ok, any_value(bad_citations) AS bad, any_value(prompt_tokens) AS pt, any_value(completion_tokens) AS ct, any_value(latency_s) AS lat, any_value(strategy) AS strategy, any_value(served_by) AS served_by, any_value(chunks) AS chunks FROM result_cells GROUP BY cell_id)"""


def cells(spark, sf_dir) -> DataFrame:
    """One row for each cell; repeated rows are equal."""
    return table(spark, sf_dir, "result_cells").dropDuplicates(["cell_id"])


def scored(spark, sf_dir) -> DataFrame:
    """Cells with their question: gold and given first answers and conditions."""
    q = table(spark, sf_dir, "questions").dropDuplicates(["qid"]).select("qid", "doc", F.col("answers").alias("gold"), F.col("not_answerable").alias("na"))
    return cells(spark, sf_dir).join(q, "qid")


@query(f"""WITH {Q}, s AS (SELECT system, len(answers) > 0 AS given, NOT na AS answerable FROM c JOIN q USING (qid)),
n AS (SELECT system, count(*) FILTER (answerable AND given) AS tp, count(*) FILTER (NOT answerable AND given) AS fp, count(*) FILTER (answerable AND NOT given) AS fn, count(*) FILTER (NOT answerable AND NOT given) AS tn FROM s GROUP BY system)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM n""")
def answerability_scores(spark, sf_dir):
    """Does a system answer where there is an answer: tp, fp, fn, tn, precision, recall, F1."""
    return M.binary_scores(scored(spark, sf_dir), ~F.col("na"), F.size("answers") > 0, ["system"])


LATEST = r"""lp AS (SELECT *, lower(regexp_replace(trim(conflict_type), '[ _-]+', '_', 'g')) AS ct, strptime(replace(labelled_at, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') AS ts FROM label_passes),
v AS (SELECT instance_id, annotator, arg_max(ct, (ts, ct)) AS ct FROM lp GROUP BY instance_id, annotator),
mj AS (SELECT instance_id, ct AS maj FROM (SELECT instance_id, ct, row_number() OVER (PARTITION BY instance_id ORDER BY count(*) DESC, ct) AS r FROM v GROUP BY instance_id, ct) WHERE r = 1)"""


def votes(spark, sf_dir) -> DataFrame:
    """The latest conflict type of each annotator for each item."""
    p = table(spark, sf_dir, "label_passes").select("instance_id", "annotator", F.lower(F.regexp_replace(F.trim("conflict_type"), "[ _-]+", "_")).alias("ct"), F.to_timestamp("labelled_at").alias("at"))
    return p.groupBy("instance_id", "annotator").agg(F.max(F.struct("at", "ct"))["ct"].alias("ct"))


def majority(v: DataFrame) -> DataFrame:
    n = v.groupBy("instance_id", "ct").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("instance_id").agg(F.min(F.struct(-F.col("n"), "ct"))["ct"].alias("maj"))


@query(f"WITH {LATEST} SELECT maj AS gold, ct AS predicted, count(*) AS n FROM v JOIN mj USING (instance_id) GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    """Majority label against each annotator's label."""
    v = votes(spark, sf_dir)
    return v.join(majority(v), "instance_id").groupBy(F.col("maj").alias("gold"), F.col("ct").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LATEST}, x AS (SELECT maj AS g, ct AS p, count(*) AS n FROM v JOIN mj USING (instance_id) GROUP BY ALL), r AS (SELECT g AS label, sum(n) AS support, sum(CASE WHEN g = p THEN n ELSE 0 END) AS tp FROM x GROUP BY g), k AS (SELECT p AS label, sum(n) AS n_predicted FROM x GROUP BY p)
SELECT label, coalesce(support, 0)::BIGINT AS support, coalesce(n_predicted, 0)::BIGINT AS n_predicted, coalesce(tp, 0)::BIGINT AS tp, round(coalesce(tp / nullif(n_predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(support + n_predicted, 0), 0), 6) AS f1 FROM r FULL JOIN k USING (label)""")
def label_prf(spark, sf_dir):
    """Precision, recall and F1 of each label."""
    v = votes(spark, sf_dir)
    return M.label_scores(v.join(majority(v), "instance_id").select(F.col("maj").alias("gold"), F.col("ct").alias("predicted")))


@query(f"""WITH {LATEST}, p AS (SELECT a.annotator AS a, b.annotator AS b, a.ct AS ca, b.ct AS cb FROM v a JOIN v b ON a.instance_id = b.instance_id AND a.annotator < b.annotator),
s AS (SELECT a, b, count(*) AS n, count(*) FILTER (ca = cb) AS same FROM p GROUP BY a, b), ra AS (SELECT a, b, ca AS c, count(*) AS na FROM p GROUP BY ALL), rb AS (SELECT a, b, cb AS c, count(*) AS nb FROM p GROUP BY ALL),
e AS (SELECT a, b, sum(coalesce(na, 0) * coalesce(nb, 0)) AS chance FROM ra FULL JOIN rb USING (a, b, c) GROUP BY a, b)
SELECT a, b, n, round(same / n, 6) AS observed, round(chance / (n * n), 6) AS expected, round(CASE WHEN chance < n * n THEN (same / n - chance / (n * n)) / (1 - chance / (n * n)) END, 6) AS kappa FROM s JOIN e USING (a, b)""")
def cohen_kappa(spark, sf_dir):
    """Kappa of every two annotators on the items both labelled: an item has few annotators, so pairs are few."""
    v = votes(spark, sf_dir)
    a, b = v.select("instance_id", F.col("annotator").alias("a"), F.col("ct").alias("ca")), v.select("instance_id", F.col("annotator").alias("b"), F.col("ct").alias("cb"))
    return M.kappa(a.join(b, "instance_id").where("a < b"), "ca", "cb", ["a", "b"])


SCORES = f"""{Q}, sc AS (SELECT system, round(ct::DOUBLE / (pt + ct), 3) AS score, bad > 0 AS label FROM c), th AS (SELECT system, score AS t, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM sc GROUP BY ALL),
tt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY system) AS np, sum(neg) OVER (PARTITION BY system) AS nn FROM th WINDOW w AS (PARTITION BY system ORDER BY t DESC ROWS UNBOUNDED PRECEDING))"""


def _scores(spark, sf_dir):
    s = F.round(F.col("completion_tokens") / (F.col("prompt_tokens") + F.col("completion_tokens")), 3)
    return cells(spark, sf_dir).select("system", s.alias("score"), (F.col("bad_citations") > 0).alias("label"))


@query(f"WITH {SCORES} SELECT system, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, round(sum(pos * (nn - fp) + 0.5 * pos * neg) / nullif(max(np * nn), 0), 6) AS auc FROM tt GROUP BY system")
def auc_with_ties(spark, sf_dir):
    """AUC of a score for bad citations, ties counted half."""
    return M.auc(_scores(spark, sf_dir), "score", "label", ["system"])


@query(f"""WITH {SCORES}, z AS (SELECT *, round(2 * tp / (tp + fp + np), 9) AS f, round((tp + nn - fp) / (np + nn), 9) AS a FROM tt)
SELECT system, round(arg_max(f, (f, t)), 6) AS f1, arg_max(t, (f, t)) AS f1_threshold, round(max(a), 6) AS accuracy, arg_max(t, (a, -t)) AS accuracy_threshold FROM z GROUP BY system""")
def best_thresholds(spark, sf_dir):
    """Thresholds of highest F1 (ties higher) and of highest accuracy (ties lower)."""
    return M.best_threshold(_scores(spark, sf_dir), "score", "label", ["system"])


@query(f"""WITH {SCORES} SELECT system, round(sum(CASE WHEN pos > 0 THEN pos * (tp / (tp + fp)) ELSE 0 END) / nullif(max(np), 0), 6) AS average_precision FROM tt GROUP BY system""")
def average_precision(spark, sf_dir):
    """Step-wise average precision over distinct scores."""
    t = M.threshold_table(_scores(spark, sf_dir), "score", "label", ["system"])
    return t.groupBy("system").agg(F.round(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("n_pos").cast("double")), 6).alias("average_precision"))


@query(f"""WITH {Q}, m AS (SELECT model, system, strategy, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 9) AS okr, round(avg(ct), 9) AS cost FROM c GROUP BY ALL),
z AS (SELECT *, max(okr) OVER (PARTITION BY model ORDER BY cost, okr DESC, system, strategy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m) SELECT model, system, strategy, round(okr, 6) AS ok_rate, round(cost, 6) AS mean_tokens FROM z WHERE best IS NULL OR okr > best""")
def pareto_front(spark, sf_dir):
    """Settings that no cheaper setting of the model matches in parsed replies."""
    m = cells(spark, sf_dir).groupBy("model", "system", "strategy").agg(F.round(F.avg(F.col("ok").cast("double")), 9).alias("okr"), F.round(F.avg("completion_tokens"), 9).alias("cost"))
    w = Window.partitionBy("model").orderBy("cost", F.desc("okr"), "system", "strategy").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("best", F.max("okr").over(w)).where("best IS NULL OR okr > best").select("model", "system", "strategy", F.round("okr", 6).alias("ok_rate"), F.round("cost", 6).alias("mean_tokens"))


@query(f"""WITH {Q} SELECT model, system, count(*) AS n_cells, count(*) FILTER (ok) AS n_ok, sum(pt)::BIGINT AS prompt_tokens, round(avg(lat), 6) AS mean_latency, grouping(model, system)::BIGINT AS level FROM c GROUP BY GROUPING SETS ((model, system), (model), (system), ())""")
def results_by_stratum(spark, sf_dir):
    """Cells per model and system, per each, and in all."""
    return cells(spark, sf_dir).groupingSets([["model", "system"], ["model"], ["system"], []], "model", "system").agg(F.count(F.lit(1)).alias("n_cells"), M.count_if(F.col("ok")).alias("n_ok"), F.sum("prompt_tokens").alias("prompt_tokens"), F.round(F.avg("latency_s"), 6).alias("mean_latency"), F.grouping_id().cast("bigint").alias("level"))


@query(f"""WITH {Q} SELECT system, count(*) AS n, round(quantile_disc(lat, 0.5), 6) AS p50, round(max(lat), 6) AS longest, round(quantile_cont(lat, 0.9), 6) AS p90 FROM c WHERE lat IS NOT NULL GROUP BY system""")
def latency_percentiles(spark, sf_dir):
    """Median, 90th percentile and longest latency of each system."""
    return cells(spark, sf_dir).where("latency_s IS NOT NULL").groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_s)"), 6).alias("p50"), F.round(F.max("latency_s"), 6).alias("longest"), F.round(F.percentile("latency_s", F.lit(0.9)), 6).alias("p90"))


@query(f"""WITH {Q}, s AS (SELECT cell_id, CASE WHEN na THEN 'unanswerable' WHEN len(list_filter(gold, lambda a: len(a.conditions) > 0)) > 0 THEN 'conditional' ELSE 'unconditional' END AS kind,
list_distinct(flatten(list_transform(answers, lambda a: a.conditions))) AS p, list_distinct(flatten(list_transform(gold, lambda a: a.conditions))) AS g FROM c JOIN q USING (qid)),
n AS (SELECT cell_id, kind, len(list_intersect(p, g)) AS ok, len(p) AS np, len(g) AS ng FROM s),
k AS (SELECT kind, CASE WHEN kind = 'unanswerable' THEN CASE WHEN np > 0 THEN 'spurious' ELSE 'none' END WHEN ng = 0 THEN CASE WHEN np > 0 THEN 'spurious' ELSE 'no_condition_needed' END WHEN np = 0 THEN 'omitted' WHEN ok = 0 THEN 'wrong' WHEN ok < ng OR np > ok THEN 'partial' ELSE 'all' END AS class FROM n)
SELECT kind, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM k GROUP BY kind, class""")
def condition_taxonomy(spark, sf_dir):
    """What replies do with the conditions of an answer, per kind of question."""
    cond = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda a: a["conditions"])))
    s = scored(spark, sf_dir).withColumn("kind", F.when(F.col("na"), "unanswerable").when(F.exists("gold", lambda a: F.size(a["conditions"]) > 0), "conditional").otherwise("unconditional"))
    s = s.select("kind", cond("answers").alias("p"), cond("gold").alias("g")).select("kind", F.size(F.array_intersect("p", "g")).alias("ok"), F.size("p").alias("np"), F.size("g").alias("ng"))
    spurious = F.col("np") > 0
    k = F.when(F.col("kind") == "unanswerable", F.when(spurious, "spurious").otherwise("none")).when(F.col("ng") == 0, F.when(spurious, "spurious").otherwise("no_condition_needed"))
    k = k.when(F.col("np") == 0, "omitted").when(F.col("ok") == 0, "wrong").when((F.col("ok") < F.col("ng")) | (F.col("np") > F.col("ok")), "partial").otherwise("all")
    n = s.groupBy("kind", k.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("kind", "class", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6).alias("share"))


TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""WITH {Q}, s AS (SELECT cell_id, system, {TOK.format('answers[1].answer')} AS a, {TOK.format('gold[1].answer')} AS g FROM c JOIN q USING (qid) WHERE len(answers) > 0 AND len(gold) > 0),
ta AS (SELECT cell_id, t, count(*) AS n FROM (SELECT cell_id, unnest(a) AS t FROM s) GROUP BY ALL), tg AS (SELECT cell_id, t, count(*) AS n FROM (SELECT cell_id, unnest(g) AS t FROM s) GROUP BY ALL),
o AS (SELECT cell_id, sum(least(ta.n, tg.n)) AS c FROM ta JOIN tg USING (cell_id, t) GROUP BY cell_id)
SELECT system, count(*) AS n, round(avg(CASE WHEN len(a) + len(g) = 0 THEN 0 ELSE 2.0 * coalesce(c, 0) / (len(a) + len(g)) END), 6) AS token_f1, round(avg(CASE WHEN a = g THEN 1.0 ELSE 0 END), 6) AS exact FROM s LEFT JOIN o USING (cell_id) GROUP BY system""")
def token_f1(spark, sf_dir):
    """Multiset token F1 and exact match of the first answer against the first gold answer."""
    first = lambda c: T.tokens(F.get(c, F.lit(0))["answer"])
    s = scored(spark, sf_dir).where("size(answers) > 0 AND size(gold) > 0").select("system", first(F.col("answers")).alias("a"), first(F.col("gold")).alias("g"))
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    both = F.aggregate(F.array_intersect("a", "g"), F.lit(0), lambda n, w: n + F.least(count(F.col("a"), w), count(F.col("g"), w)))
    f1 = F.coalesce(F.try_divide(2.0 * both, (F.size("a") + F.size("g")).cast("double")), F.lit(0.0))
    return s.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f1), 6).alias("token_f1"), F.round(F.avg((F.col("a") == F.col("g")).cast("double")), 6).alias("exact"))


Z = "1.959963984540054"


@query(f"""WITH {Q}, n AS (SELECT system, count(*) FILTER (ok) AS k, count(*) AS n FROM c GROUP BY system), p AS (SELECT *, k / n AS p, 1 + {Z} * {Z} / n AS d FROM n)
SELECT system, k, n, round(greatest(0, (p + {Z} * {Z} / (2 * n) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / d), 6) AS low, round(least(1, (p + {Z} * {Z} / (2 * n) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / d), 6) AS high FROM p""")
def wilson_intervals(spark, sf_dir):
    """Share of parsed replies with its Wilson interval."""
    n = cells(spark, sf_dir).groupBy("system").agg(M.count_if(F.col("ok")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = I.wilson(F.col("k"), F.col("n"))
    return n.select("system", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def horner_sql(c: tuple[float, ...], x: str) -> str:
    out = str(c[0])
    for a in c[1:]:
        out = f"({out} * {x} + {a})"
    return out.replace("+ -", "- ")


def erfc_sql(z: str) -> str:
    """erfc of a number of 0 or more, by the same approximation."""
    t = f"(1 / (1 + 0.5 * {z}))"
    return f"({t} * exp(-{z} * {z} + {horner_sql(I.ERFC[::-1], t)}))"


def quantile_sql(p: str) -> str:
    q, u, v = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"{horner_sql(I.TAIL[0], x)} / {horner_sql(I.TAIL[1], x)}"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(u)} WHEN {p} > 0.97575 THEN -({tail(v)}) ELSE {q} * {horner_sql(I.CENTRE[0], f'({q} * {q})')} / {horner_sql(I.CENTRE[1], f'({q} * {q})')} END)"


def cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2))"
    return f"(CASE WHEN {x} <= 0 THEN 0.5 * {erfc_sql(z)} ELSE 1 - 0.5 * {erfc_sql(z)} END)"


PAIRED = f"""{Q}, s AS (SELECT system, qid, bool_and(ok) AS ok FROM c GROUP BY system, qid), pr AS (SELECT a.system AS a, b.system AS b, count(*) FILTER (a.ok AND NOT b.ok) AS bb, count(*) FILTER (b.ok AND NOT a.ok) AS cc, count(*) AS n FROM s a JOIN s b ON a.qid = b.qid AND a.system < b.system GROUP BY ALL),
pv AS (SELECT *, CASE WHEN bb + cc = 0 THEN 1.0 WHEN bb + cc < 25 THEN least(1.0, 2 * list_sum(list_transform(range(least(bb, cc) + 1), lambda i: exp(lgamma(bb + cc + 1) - lgamma(i + 1) - lgamma(bb + cc - i + 1) - (bb + cc) * ln(2)))))
 ELSE least(1.0, {erfc_sql('sqrt((abs(bb - cc) - 1) ** 2 / (bb + cc) / 2)')}) END AS p FROM pr)"""


def _paired(spark, sf_dir):
    s = cells(spark, sf_dir).groupBy("system", "qid").agg(F.bool_and("ok").alias("ok"))
    a, b = s.select("qid", F.col("system").alias("a"), F.col("ok").alias("oa")), s.select("qid", F.col("system").alias("b"), F.col("ok").alias("ob"))
    n = a.join(b, "qid").where("a < b").groupBy("a", "b").agg(M.count_if(F.col("oa") & ~F.col("ob")).alias("bb"), M.count_if(F.col("ob") & ~F.col("oa")).alias("cc"), F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", I.mcnemar(F.col("bb"), F.col("cc")))


@query(f"WITH {PAIRED} SELECT a, b, bb, cc, n, round(p, 6) AS p FROM pv")
def mcnemar_exact(spark, sf_dir):
    """McNemar test of every two systems on the questions both answered, exact under 25 discordant ones."""
    return _paired(spark, sf_dir).withColumn("p", F.round("p", 6))


@query(f"""WITH {PAIRED}, x AS (SELECT a || ' / ' || b AS test, round(p, 9) AS p FROM pv), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM x),
h AS (SELECT test, p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS adj FROM r) SELECT test, round(p, 6) AS p, round(adj, 6) AS p_adjusted, adj < 0.05 AS rejected FROM h""")
def holm_family(spark, sf_dir):
    """Holm's correction over that family of tests."""
    t = _paired(spark, sf_dir).select(F.concat_ws(" / ", "a", "b").alias("test"), F.round("p", 9).alias("p"))
    return I.holm(t, "p", "test").select("test", F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"), "rejected")


UNITS = f"""{Q}, un AS (SELECT system, doc AS unit, sum(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS s, count(*) AS n FROM c JOIN q USING (qid) GROUP BY ALL)"""


def _units(spark, sf_dir):
    """Sums per page: the page is the independent unit."""
    return scored(spark, sf_dir).groupBy("system", F.col("doc").alias("unit")).agg(F.sum(F.col("ok").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {UNITS}, u AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY system) AS m FROM un),
pk AS (SELECT system, d AS draw, ('0x' || substr(md5('b|' || d || '|' || i), 1, 8))::BIGINT % m AS i FROM u, (SELECT unnest(range(200)) AS d)),
dr AS (SELECT system, draw, sum(s) / sum(n) AS mean FROM pk JOIN u USING (system, i) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY mean) - 1 AS r, count(*) OVER (PARTITION BY system) AS b FROM dr)
SELECT system, round(max(CASE WHEN r = least(floor(0.025 * b), b - 1) THEN mean END), 6) AS low, round(max(CASE WHEN r = least(floor(0.975 * b), b - 1) THEN mean END), 6) AS high, max(b) AS n_draws FROM o GROUP BY system""")
def cluster_bootstrap_interval(spark, sf_dir):
    """Percentile interval of the parsed share, pages drawn with replacement."""
    return I.percentile_interval(I.cluster_bootstrap(_units(spark, sf_dir), ["system"]), ["system"], "mean")


@query(f"""WITH {UNITS}, l AS (SELECT system, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS v FROM un WINDOW w AS (PARTITION BY system)), d AS (SELECT system, avg(v) OVER (PARTITION BY system) - v AS d FROM l)
SELECT system, count(*) AS n_units, round(CASE WHEN sum(d * d) > 1e-18 THEN sum(d * d * d) / (6 * pow(sum(d * d), 1.5)) ELSE 0 END, 6) AS acceleration FROM d GROUP BY system""")
def jackknife_acceleration(spark, sf_dir):
    """Acceleration of the bias-corrected interval, page by page left out."""
    return I.jackknife(_units(spark, sf_dir), ["system"])


@query(f"""WITH {Q}, x AS (SELECT doc AS key, sum(CASE WHEN system = 'top8' THEN 1.0::DOUBLE ELSE -1.0 END * CASE WHEN ok THEN 1 ELSE 0 END) AS s FROM c JOIN q USING (qid) WHERE system IN ('top8', 'top5') GROUP BY doc),
f AS (SELECT d, sum(CASE WHEN ('0x' || substr(md5('s|' || d || '|' || key), 1, 8))::BIGINT % 2 = 0 THEN s ELSE -s END) AS t FROM x, (SELECT unnest(range(2000)) AS d) GROUP BY d), o AS (SELECT sum(s) AS obs, count(*) AS n_clusters FROM x)
SELECT round(obs, 6) AS obs, n_clusters, round((count(*) FILTER (abs(t) >= abs(obs) - 1e-9) + 1) / (count(*) + 1), 6) AS p FROM f, o GROUP BY obs, n_clusters""")
def cluster_sign_flip(spark, sf_dir):
    """Sign-flip test of the difference of two systems, pages as units."""
    side = F.when(F.col("system") == "top8", 1.0).otherwise(-1.0)
    s = scored(spark, sf_dir).where(F.col("system").isin("top8", "top5")).groupBy(F.col("doc").alias("key")).agg(F.sum(side * F.col("ok").cast("int")).alias("s"))
    return I.sign_flip(s)


@query(rf"""WITH {Q}, x AS (SELECT system, ct::DOUBLE AS x, pt::DOUBLE AS y FROM c), r AS (SELECT *, rank() OVER (PARTITION BY system ORDER BY x) + (count(*) OVER (PARTITION BY system, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY system ORDER BY y) + (count(*) OVER (PARTITION BY system, y) - 1) / 2 AS ry FROM x)
SELECT system, round(coalesce(corr(x, y), 0), 6) AS pearson, round(coalesce(corr(rx, ry), 0), 6) AS spearman FROM r GROUP BY system""")
def pearson_spearman(spark, sf_dir):
    """Correlation of values and of average ranks."""
    x = cells(spark, sf_dir).select("system", F.col("completion_tokens").cast("double").alias("x"), F.col("prompt_tokens").cast("double").alias("y"))
    mean_rank = lambda c: F.rank().over(Window.partitionBy("system").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("system", c)) - 1) / 2
    r = x.withColumn("rx", mean_rank("x")).withColumn("ry", mean_rank("y"))
    return r.groupBy("system").agg(F.round(F.coalesce(F.corr("x", "y"), F.lit(0.0)), 6).alias("pearson"), F.round(F.coalesce(F.corr("rx", "ry"), F.lit(0.0)), 6).alias("spearman"))


Z975, Z80, Z05 = f"{I.quantile(0.975)}::DOUBLE", f"{I.quantile(0.8)}::DOUBLE", f"({I.quantile(0.05)}::DOUBLE)"
BCA = f"""{UNITS}, u AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY system) AS m FROM un),
pk AS (SELECT system, d AS draw, ('0x' || substr(md5('b|' || d || '|' || i), 1, 8))::BIGINT % m AS i FROM u, (SELECT unnest(range(200)) AS d)), dr AS (SELECT system, draw, sum(s) / sum(n) AS mean FROM pk JOIN u USING (system, i) GROUP BY ALL),
pt AS (SELECT system, sum(s) / sum(n) AS point, count(*) AS n_units FROM un GROUP BY system), jk AS (SELECT system, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS v FROM un WINDOW w AS (PARTITION BY system)), dj AS (SELECT system, avg(v) OVER (PARTITION BY system) - v AS d FROM jk),
ac AS (SELECT system, CASE WHEN sum(d * d) > 1e-18 THEN sum(d * d * d) / (6 * pow(sum(d * d), 1.5)) ELSE 0 END AS a FROM dj GROUP BY system), bl AS (SELECT system, greatest(1.0 / 201, least(1 - 1.0 / 201, avg((mean < point)::INT))) AS below FROM dr JOIN pt USING (system) GROUP BY system),
zz AS (SELECT system, a, {quantile_sql('below')} AS z0 FROM bl JOIN ac USING (system))"""


def _level(z: str) -> str:
    return cdf_sql(f"(z0 + (z0 + {z}) / (1 - a * (z0 + {z})))")


@query(f"""WITH {BCA}, lv AS (SELECT system, {_level(f'-{Z975}')} AS lo, {_level(Z975)} AS hi FROM zz), o AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY mean) - 1 AS r FROM dr)
SELECT system, round(any_value(point), 6) AS point, round(max(CASE WHEN r = least(floor(lo * 200), 199) THEN mean END), 6) AS low, round(max(CASE WHEN r = least(floor(hi * 200), 199) THEN mean END), 6) AS high, any_value(n_units) AS n_units FROM o JOIN lv USING (system) JOIN pt USING (system) GROUP BY system""")
def bca_intervals(spark, sf_dir):
    """Bias-corrected and accelerated interval of the parsed share, pages as units."""
    return I.bca(_units(spark, sf_dir), ["system"])


@query(f"""WITH {BCA}, lv AS (SELECT system, {_level(Z05)} AS lo FROM zz), o AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY mean) - 1 AS r FROM dr)
SELECT system, round(any_value(point), 6) AS point, round(max(CASE WHEN r = least(floor(lo * 200), 199) THEN mean END), 6) AS low, any_value(n_units) AS n_units FROM o JOIN lv USING (system) JOIN pt USING (system) GROUP BY system""")
def one_sided_lower(spark, sf_dir):
    """One-sided lower bound of the parsed share."""
    return I.bca(_units(spark, sf_dir), ["system"], one_sided=True).drop("high")


DIFF = f"""{Q}, px AS (SELECT doc AS unit, coalesce(sum(ok::INT) FILTER (system = 'top8'), 0)::DOUBLE AS sa, count(*) FILTER (system = 'top8') AS na, coalesce(sum(ok::INT) FILTER (system = 'top5'), 0)::DOUBLE AS sb, count(*) FILTER (system = 'top5') AS nb FROM c JOIN q USING (qid) WHERE system IN ('top8', 'top5') GROUP BY doc),
u AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS m FROM px), pk AS (SELECT d AS draw, ('0x' || substr(md5('b|' || d || '|' || i), 1, 8))::BIGINT % m AS i FROM u, (SELECT unnest(range(200)) AS d)),
dr AS (SELECT draw, sum(sa) / nullif(sum(na), 0) - sum(sb) / nullif(sum(nb), 0) AS mean FROM pk JOIN u USING (i) GROUP BY draw)"""


@query(f"""WITH {DIFF}, o AS (SELECT *, row_number() OVER (ORDER BY mean) - 1 AS r, count(*) OVER () AS b FROM dr WHERE mean IS NOT NULL) SELECT round((SELECT sum(sa) / sum(na) - sum(sb) / sum(nb) FROM px), 6) AS difference,
round(max(CASE WHEN r = least(floor(0.025 * b), b - 1) THEN mean END), 6) AS low, round(max(CASE WHEN r = least(floor(0.975 * b), b - 1) THEN mean END), 6) AS high, round(avg((mean <= 0)::INT), 6) AS p_at_most_zero FROM o""")
def bootstrap_difference(spark, sf_dir):
    """Difference of two systems on the same draws of pages: interval, and the share of draws at 0 or below."""
    side = lambda s, v: F.sum(F.when(F.col("system") == s, v).otherwise(F.lit(0.0)))
    ok = F.col("ok").cast("double")
    x = scored(spark, sf_dir).where(F.col("system").isin("top8", "top5")).groupBy(F.col("doc").alias("unit"))
    x = x.agg(side("top8", ok).alias("sa"), side("top8", F.lit(1.0)).alias("na"), side("top5", ok).alias("sb"), side("top5", F.lit(1.0)).alias("nb"))
    return I.paired_bootstrap(x)


@query(f"""WITH {Q}, x AS (SELECT model, served_by AS unit, sum(CASE WHEN system = 'top8' THEN 1.0::DOUBLE ELSE -1.0 END * ok::INT) AS s FROM c WHERE system IN ('top8', 'top5') AND served_by IS NOT NULL GROUP BY ALL), k AS (SELECT model, list(s ORDER BY unit) AS d FROM x GROUP BY model HAVING count(*) <= 16),
m AS (SELECT model, d, unnest(range((2 ** len(d))::BIGINT)) AS m FROM k), t AS (SELECT model, len(d) AS n, abs(list_sum(d)) AS obs, abs(list_sum(list_transform(d, lambda x, j: CASE WHEN (m >> (j - 1)::INT) & 1 = 1 THEN x ELSE -x END))) AS t FROM m)
SELECT model, n, round(obs, 9) AS obs, round(avg((t >= obs - 1e-9)::INT), 9) AS p FROM t GROUP BY model, n, obs""")
def sign_flip_enumerated(spark, sf_dir):
    """Sign-flip test by all signs, providers as units: exact for up to sixteen."""
    side = F.when(F.col("system") == "top8", 1.0).otherwise(-1.0)
    x = cells(spark, sf_dir).where(F.col("system").isin("top8", "top5") & F.col("served_by").isNotNull()).groupBy("model", F.col("served_by").alias("unit")).agg(F.sum(side * F.col("ok").cast("int")).alias("s"))
    return I.sign_flip_exact(x, ["model"])


P = "(0.5 + e / (2 * d))"
NEED = f"ceil(({Z975} * 0.5 + {Z80} * sqrt(greatest({P} * (1 - {P}), 0))) ** 2 / ({P} - 0.5) ** 2)"


@query(f"""WITH g AS (SELECT round(e.i * 0.05, 2)::DOUBLE AS e, round(d.i * 0.1, 1)::DOUBLE AS d FROM range(1, 7) e(i), range(2, 9) d(i)) SELECT e AS effect, d AS discordant, CASE WHEN {P} >= 1 THEN 0 ELSE {NEED} END::BIGINT AS n_discordant, CASE WHEN {P} >= 1 THEN 0 ELSE ceil({NEED} / d) END::BIGINT AS n_items,
ceil(({Z975} * sqrt(2 * (0.3 + e / 2) * (1 - 0.3 - e / 2)) + {Z80} * sqrt(0.3 * 0.7 + (0.3 + e) * (0.7 - e))) ** 2 / (e * e))::BIGINT AS n_unpaired FROM g""")
def sample_sizes(spark, sf_dir):
    """Items that a paired and an unpaired comparison need, over a grid of effects and discordance."""
    g = spark.range(1, 7).select(F.round(F.col("id") * 0.05, 2).alias("e")).crossJoin(spark.range(2, 9).select(F.round(F.col("id") * 0.1, 1).alias("d")))  # 42 rows
    disc, items = I.paired_size(F.col("e"), F.col("d"))
    return g.select(F.col("e").alias("effect"), F.col("d").alias("discordant"), disc.alias("n_discordant"), items.alias("n_items"), I.proportion_size(F.lit(0.3), F.col("e")).alias("n_unpaired"))


LCH = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(f"""WITH g AS (SELECT n, 0.4::DOUBLE AS d, round(x.i * 0.05, 2) AS delta FROM (SELECT unnest([20, 40, 60])::BIGINT AS n), range(1, 9) x(i)), m AS (SELECT g.*, m.m FROM g, range(0, 61) m(m) WHERE m <= n),
b AS (SELECT m.*, b.b FROM m, range(0, 61) b(b) WHERE b.b <= m.m), t AS (SELECT *, CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, m - b) + 1), lambda i: exp({LCH.format('m', 'i')} - m * ln(2))))) END AS p FROM b)
SELECT n, delta, round(sum(CASE WHEN p <= 0.05 THEN exp({LCH.format('n', 'm')} + m * ln(d) + (n - m) * ln(1 - d)) * exp({LCH.format('m', 'b')}) * pow((d + delta) / (2 * d), b) * pow(1 - (d + delta) / (2 * d), m - b) ELSE 0 END), 6) AS power FROM t GROUP BY n, delta""")
def mcnemar_power(spark, sf_dir):
    """Exact power of McNemar's test for 20, 40 and 60 items at a discordance of 0.4, over differences: a double sum."""
    g = spark.createDataFrame([(n, i * 0.05) for n in (20, 40, 60) for i in range(1, 9)], "n bigint, delta double").withColumn("delta", F.round("delta", 2))
    return I.mcnemar_power(g, 0.4)
