"""Reviews and annotation passes: hours, plausibility, truth of two reviewers, thresholds, audits, detectors."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import inference as I
from quernstone.operators import metrics as M
from quernstone.queries._registry import family
from quernstone.queries.evaluation import Z, cells
from quernstone.queries.pairs import FEATURES, NLI, PAIRS, REL, _featured, _ruled, gold
from quernstone.operators import pairs as P
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()

# the latest pass of each annotator on each item
LAST = r"""lx AS (SELECT instance_id, annotator, lower(regexp_replace(trim(conflict_type), '[ _-]+', '_', 'g')) AS ct, coalesce(escalated, false) AS escalated, coalesce(is_distractor, false) AS dist, basis, seconds_spent AS sec, strptime(replace(labelled_at, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') AS ts FROM label_passes),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, annotator ORDER BY ts DESC, ct DESC, sec DESC NULLS LAST, basis DESC NULLS LAST, escalated DESC) AS r FROM lx) WHERE r = 1)"""


def latest(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "label_passes").select(
        "instance_id", "annotator", F.lower(F.regexp_replace(F.trim("conflict_type"), "[ _-]+", "_")).alias("ct"), F.coalesce("escalated", F.lit(False)).alias("escalated"), F.coalesce("is_distractor", F.lit(False)).alias("dist"),
        "basis", F.col("seconds_spent").alias("sec"), F.to_timestamp("labelled_at").alias("ts"),
    )
    w = Window.partitionBy("instance_id", "annotator").orderBy(F.desc("ts"), F.desc("ct"), F.desc_nulls_last("sec"), F.desc_nulls_last("basis"), F.desc("escalated"))
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query(f"WITH {LAST}, h AS (SELECT annotator, basis, round(sum(sec) / 3600, 6) AS hours FROM (SELECT DISTINCT instance_id, annotator, basis, sec, ts FROM lx) GROUP BY ALL), d AS (SELECT annotator, basis, count(*) AS n_decisions FROM lt GROUP BY ALL) SELECT h.annotator, h.basis, hours, coalesce(n_decisions, 0)::BIGINT AS n_decisions FROM h LEFT JOIN d ON d.annotator = h.annotator AND d.basis IS NOT DISTINCT FROM h.basis")
def review_hours(spark, sf_dir):
    """Hours of each annotator and basis over all passes, and decisions that stand."""
    p = table(spark, sf_dir, "label_passes").select("instance_id", "annotator", "basis", "seconds_spent", F.to_timestamp("labelled_at").alias("ts")).distinct()
    h = p.groupBy("annotator", "basis").agg(F.round(F.sum("seconds_spent") / 3600, 6).alias("hours"))
    d = latest(spark, sf_dir).groupBy(F.col("annotator").alias("a"), F.col("basis").alias("b")).agg(F.count(F.lit(1)).alias("n_decisions"))
    return h.join(d, (F.col("annotator") == F.col("a")) & F.col("basis").eqNullSafe(F.col("b")), "left").select("annotator", "basis", "hours", F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


@query(f"WITH {LAST}, s AS (SELECT annotator, sec, ts, row_number() OVER (PARTITION BY annotator ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY annotator) AS n FROM lt WHERE sec IS NOT NULL) SELECT annotator, count(*) AS n, round(max(CASE WHEN i = n // 2 THEN sec END), 6) AS median_upper, round(min(sec), 6) AS least, count(*) FILTER (sec < 5) AS n_under_five, (epoch(max(ts)) - epoch(min(ts)))::BIGINT AS span_seconds FROM s GROUP BY annotator")
def pass_timing(spark, sf_dir):
    """Plausibility of a pass: upper median and least seconds, items under five seconds, and the time it spans."""
    w = Window.partitionBy("annotator")
    s = latest(spark, sf_dir).where("sec IS NOT NULL").withColumn("i", F.row_number().over(w.orderBy("sec")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return s.groupBy("annotator").agg(F.count(F.lit(1)).alias("k"), F.round(F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("sec"))), 6).alias("median_upper"), F.round(F.min("sec"), 6).alias("least"), M.count_if(F.col("sec") < 5).alias("n_under_five"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("span_seconds")).withColumnRenamed("k", "n")


TRUTH = f"{LAST}, o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ts, annotator) AS k FROM lt), tr AS (SELECT a.instance_id, a.ct = 'conditional' AS ya, b.ct = 'conditional' AS yb, c.ct = 'conditional' AS yc FROM o a JOIN o b ON b.instance_id = a.instance_id AND b.k = 2 LEFT JOIN o c ON c.instance_id = a.instance_id AND c.k = 3 AND c.escalated WHERE a.k = 1)"


def truth(spark, sf_dir) -> DataFrame:
    """(instance_id, truth, how): yes or no of the first two reviewers where they agree, else of an escalated third, else disputed."""
    o = latest(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("instance_id").orderBy("ts", "annotator")))
    said = lambda k, name, when=F.lit(True): o.where(F.col("k") == k).where(when).select("instance_id", (F.col("ct") == "conditional").alias(name))
    d = said(1, "ya").join(said(2, "yb"), "instance_id").join(said(3, "yc", F.col("escalated")), "instance_id", "left")
    t = F.when(F.col("ya") == F.col("yb"), F.col("ya")).otherwise(F.col("yc"))
    return d.select("instance_id", t.alias("truth"), F.when(F.col("ya") == F.col("yb"), "agreed").when(F.col("yc").isNotNull(), "adjudicated").otherwise("disputed").alias("how"))


@query(f"WITH {TRUTH} SELECT instance_id, CASE WHEN ya = yb THEN ya ELSE yc END AS truth, CASE WHEN ya = yb THEN 'agreed' WHEN yc IS NOT NULL THEN 'adjudicated' ELSE 'disputed' END AS how FROM tr")
def reviewed_truth(spark, sf_dir):
    """What two reviewers agree on, what a third decided, and what is disputed."""
    return truth(spark, sf_dir)


DEC = f"{TRUTH}, ds AS (SELECT instance_id, round(least(1, avg(sec) / 120), 6) AS score, count(DISTINCT ct) = 1 AS determined FROM lt WHERE sec IS NOT NULL GROUP BY instance_id), dt AS (SELECT ds.*, CASE WHEN ya = yb THEN ya ELSE yc END AS truth FROM ds LEFT JOIN tr USING (instance_id))"


def decisions(spark, sf_dir) -> DataFrame:
    d = latest(spark, sf_dir).where("sec IS NOT NULL").groupBy("instance_id").agg(F.round(F.least(F.lit(1.0), F.avg("sec") / 120), 6).alias("score"), (F.count_distinct("ct") == 1).alias("determined"))
    return d.join(truth(spark, sf_dir).select("instance_id", "truth"), "instance_id", "left")


@query(f"WITH {DEC}, p AS (SELECT score AS t, count(*) FILTER (truth) AS y, count(*) AS n FROM dt WHERE truth IS NOT NULL GROUP BY score), c AS (SELECT t, sum(y) OVER w / sum(n) OVER w AS precision, sum(n) OVER w AS accepted FROM p WINDOW w AS (ORDER BY t DESC)) SELECT round(min(t) FILTER (precision >= 0.2), 6) AS threshold, max(accepted)::BIGINT AS n FROM c")
def calibrated_threshold(spark, sf_dir):
    """The smallest observed score at which what is accepted reaches a precision of 0.2; null where none does."""
    by = decisions(spark, sf_dir).where("truth IS NOT NULL").groupBy(F.col("score").alias("t")).agg(M.count_if(F.col("truth")).alias("y"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("t"))  # a row for each distinct score, of a million at most as scores have six places
    c = by.select("t", (F.sum("y").over(w) / F.sum("n").over(w)).alias("precision"), F.sum("n").over(w).alias("accepted"))
    return c.agg(F.round(F.min(F.when(F.col("precision") >= 0.2, F.col("t"))), 6).alias("threshold"), F.max("accepted").alias("n"))


@query(f"""WITH {DEC}, g AS (SELECT t, count(*) FILTER (truth AND score >= t) AS tp, count(*) FILTER (NOT truth AND score >= t) AS fp, count(*) FILTER (truth AND score < t) AS fn, count(*) FILTER (NOT truth AND score < t) AS tn FROM dt, (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS t) WHERE truth IS NOT NULL GROUP BY t),
p AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, 1 + {Z} * {Z} / nullif(tp + fp, 0) AS d FROM g) SELECT t AS threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(greatest(0, (p + {Z} * {Z} / (2 * (tp + fp)) - {Z} * sqrt(p * (1 - p) / (tp + fp) + {Z} * {Z} / (4 * (tp + fp) * (tp + fp)))) / d), 6) AS precision_low FROM p WHERE tp + fp > 0""")
def decisions_at_thresholds(spark, sf_dir):
    """Accepted and rejected against the truth at four thresholds, with the lower Wilson bound of the precision."""
    d = decisions(spark, sf_dir).where("truth IS NOT NULL").withColumn("t", F.explode(F.array(*map(F.lit, (0.2, 0.3, 0.4, 0.5)))))
    y, a = F.col("truth"), F.col("score") >= F.col("t")
    g = d.groupBy("t").agg(M.count_if(y & a).alias("tp"), M.count_if(~y & a).alias("fp"), M.count_if(y & ~a).alias("fn"), M.count_if(~y & ~a).alias("tn")).where("tp + fp > 0")
    low, _ = I.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return g.select(F.col("t").alias("threshold"), "tp", "fp", "fn", "tn", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(low, 6).alias("precision_low"))


@query(f"""WITH {DEC}, s AS (SELECT instance_id, CASE WHEN score >= 0.4 THEN 0 WHEN determined THEN 1 ELSE 2 END AS st, md5('a|' || instance_id) AS h FROM dt), r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY h, instance_id) AS r FROM s), f AS (SELECT *, r <= CASE st WHEN 0 THEN 100 ELSE 50 END AS core FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN core THEN 0 ELSE 1 END, h, instance_id) AS place FROM f) SELECT instance_id, CASE st WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected_committed' ELSE 'rejected_silent' END AS stratum FROM p WHERE core OR place <= 200""")
def audit_sample(spark, sf_dir):
    """Two hundred items by hash: half accepted, the rest split between two kinds of rejected, shortfalls topped up."""
    d = decisions(spark, sf_dir).select("instance_id", F.when(F.col("score") >= 0.4, 0).when(F.col("determined"), 1).otherwise(2).alias("st"), F.md5(F.concat(F.lit("a|"), "instance_id")).alias("h"))
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("st").orderBy("h", "instance_id")))
    core = F.col("r") <= F.when(F.col("st") == 0, 100).otherwise(50)
    best = r.withColumn("o", F.when(core, 0).otherwise(1)).orderBy("o", "h", "instance_id").limit(200)  # no stratum has more than its share before the others are full
    return best.select("instance_id", F.when(F.col("st") == 0, "accepted").when(F.col("st") == 1, "rejected_committed").otherwise("rejected_silent").alias("stratum"))


@query(f"WITH {LAST} SELECT annotator, count(*) FILTER (escalated) AS n_deferred, count(*) FILTER (NOT escalated) AS n_decided, count(*) FILTER (dist) AS n_distractors FROM lt GROUP BY annotator")
def deferred_items(spark, sf_dir):
    """Items an annotator passed on, decided, and called distractors."""
    return latest(spark, sf_dir).groupBy("annotator").agg(M.count_if(F.col("escalated")).alias("n_deferred"), M.count_if(~F.col("escalated")).alias("n_decided"), M.count_if(F.col("dist")).alias("n_distractors"))


@query(f"WITH {LAST}, t AS (SELECT coalesce(team, 'none') AS team, annotator FROM annotators) SELECT team, count(DISTINCT lt.annotator) AS n_annotators, count(*) AS n_labels, count(DISTINCT instance_id) AS n_items FROM lt JOIN t USING (annotator) GROUP BY team")
def labels_by_team(spark, sf_dir):
    """Labels with their annotators' teams."""
    t = table(spark, sf_dir, "annotators").select(F.coalesce("team", F.lit("none")).alias("team"), "annotator")
    return latest(spark, sf_dir).join(t, "annotator").groupBy("team").agg(F.count_distinct("annotator").alias("n_annotators"), F.count(F.lit(1)).alias("n_labels"), F.count_distinct("instance_id").alias("n_items"))


# detectors: the strongest pair of an instance by four scores, thresholds chosen on dev, tested on test
DET = f"""{NLI}, mx AS (SELECT instance_id, max(score) AS rule, max(round(0.6 * (con + 0.25 * neu), 6)) AS ungated, max(round(least(1, con + 0.25 * neu), 6)) AS nli, max(token_jaccard) AS overlap FROM rs GROUP BY instance_id),
dd AS (SELECT mx.*, gi.split, coalesce(gi.rel, '') = 'refinement' AS y FROM mx JOIN (SELECT instance_id, any_value(split) AS split, any_value(gold_scope_relation) AS rel FROM gold_instances GROUP BY 1) gi USING (instance_id)),
lg AS (SELECT instance_id, split, y, detector, round(s::DOUBLE, 6) AS s FROM (UNPIVOT dd ON rule, ungated, nli, overlap INTO NAME detector VALUE s))"""


def detectors(spark, sf_dir) -> DataFrame:
    r = _ruled(spark, sf_dir)
    signal = P.conflict_signal(F.col("nli"))
    m = r.groupBy("instance_id").agg(F.max("score").alias("rule"), F.max(F.round(0.6 * signal, 6)).alias("ungated"), F.max(F.round(F.least(F.lit(1.0), signal), 6)).alias("nli"), F.max("token_jaccard").alias("overlap"))
    g = gold(spark, sf_dir).select("instance_id", "split", (F.coalesce("gold_scope_relation", F.lit("")) == "refinement").alias("y"))
    return m.join(g, "instance_id").unpivot(["instance_id", "split", "y"], ["rule", "ungated", "nli", "overlap"], "detector", "s").withColumn("s", F.round("s", 6))


@query(f"""WITH {DET}, th AS (SELECT detector, s AS t, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM lg WHERE split = 'dev' GROUP BY ALL), tt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS np FROM th WINDOW w AS (PARTITION BY detector ORDER BY t DESC)),
b AS (SELECT detector, arg_max(t, (round(2 * tp / (tp + fp + np), 9), t)) AS t FROM tt GROUP BY detector), e AS (SELECT detector, split, b.t, count(*) FILTER (y AND s >= b.t) AS tp, count(*) FILTER (NOT y AND s >= b.t) AS fp, count(*) FILTER (y AND s < b.t) AS fn FROM lg JOIN b USING (detector) WHERE split IN ('dev', 'test') GROUP BY ALL)
SELECT detector, split, round(t, 6) AS threshold, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM e""")
def detector_comparison(spark, sf_dir):
    """Four detectors: threshold of best F1 on dev, results on dev and test."""
    d = detectors(spark, sf_dir)
    t = M.threshold_table(d.where("split = 'dev'"), "s", "y", ["detector"])
    f1 = F.round(M.ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), 9)
    best = t.groupBy("detector").agg(F.max(F.struct(f1.alias("f"), F.col("t")))["t"].alias("t"))
    e = d.where("split IN ('dev', 'test')").join(best, "detector")
    hit = F.col("s") >= F.col("t")
    g = e.groupBy("detector", "split", "t").agg(M.count_if(F.col("y") & hit).alias("tp"), M.count_if(~F.col("y") & hit).alias("fp"), M.count_if(F.col("y") & ~hit).alias("fn"))
    return g.select("detector", "split", F.round("t", 6).alias("threshold"), "tp", "fp", "fn", F.round(M.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


@query(f"""WITH {PAIRS}, x AS (SELECT CASE WHEN exception_cues_max > 0 THEN 'cue' ELSE 'no cue' END || ' / ' || CASE WHEN numeric_clash > 0 THEN 'figures' ELSE 'no figures' END || ' / ' || CASE WHEN specificity_asymmetry >= 2 THEN 'narrower' ELSE 'level' END AS signature, {REL} AS relation FROM f) SELECT signature, count(*) AS n, count(*) FILTER (relation = 'refinement') AS n_refinement, count(DISTINCT relation) = 1 AS one_label FROM x GROUP BY signature""")
def error_signatures(spark, sf_dir):
    """Pairs by the signature of their surface patterns, and signatures on which the rule gives but one label."""
    f = _featured(spark, sf_dir)
    s = F.concat_ws(" / ", F.when(F.col("exception_cues_max") > 0, "cue").otherwise("no cue"), F.when(F.col("numeric_clash") > 0, "figures").otherwise("no figures"), F.when(F.col("specificity_asymmetry") >= 2, "narrower").otherwise("level"))
    x = f.select(s.alias("signature"), P.rule_relation({c: F.col(c) for c in FEATURES}).alias("relation"))
    return x.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), M.count_if(F.col("relation") == "refinement").alias("n_refinement"), (F.count_distinct("relation") == 1).alias("one_label"))


BANDS = f"""{NLI}, gp AS (SELECT rs.score, gi.t <> 'no_conflict' AS y FROM rs JOIN (SELECT instance_id, any_value(gold_conflict_type) AS t FROM gold_instances GROUP BY 1) gi USING (instance_id)), bw AS (SELECT i::BIGINT AS i, round(0.5 - i * 0.05, 2) AS low, round(0.5 + i * 0.05, 2) AS high FROM range(11) r(i)),
br AS (SELECT i, round(avg((score BETWEEN low AND high)::INT), 9) AS escalation, round(avg(CASE WHEN score BETWEEN low AND high THEN 0.9 ELSE ((score >= 0.5) = y)::INT END), 9) AS accuracy FROM gp, bw GROUP BY i),
fr AS (SELECT *, max(accuracy) OVER (ORDER BY escalation, accuracy DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM br), ft AS (SELECT *, lag(escalation) OVER (ORDER BY escalation) AS pe, lag(accuracy) OVER (ORDER BY escalation) AS pa FROM fr WHERE before IS NULL OR accuracy > before)"""


@query(f"""WITH {BANDS}, kn AS (SELECT i, escalation, accuracy, CASE WHEN pe IS NULL THEN -1 WHEN escalation - pe > 1e-9 THEN (accuracy - pa) / (escalation - pe) ELSE 0 END AS gain FROM ft) SELECT arg_max(i, (round(gain, 9), -i)) AS band, round(max(gain), 6) AS gain, (SELECT arg_min(i, (escalation, i)) FROM br WHERE accuracy >= 0.8) AS cheapest_at_80, (SELECT arg_max(i, (accuracy, -i)) FROM br WHERE escalation <= 0.25) AS best_within_quarter FROM kn""")
def recommended_band(spark, sf_dir):
    """The knee of the escalation curve, the cheapest band of 0.8 accuracy, and the most accurate one that escalates a quarter at most;
    a second stage is taken to be right in nine of ten."""
    y = gold(spark, sf_dir).select("instance_id", (F.col("gold_conflict_type") != "no_conflict").alias("y"))
    s = _ruled(spark, sf_dir).select("instance_id", "score").join(y, "instance_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10))))
    inside = (F.col("score") >= F.round(0.5 - F.col("i") * 0.05, 2)) & (F.col("score") <= F.round(0.5 + F.col("i") * 0.05, 2))
    right = F.when(inside, 0.9).otherwise(((F.col("score") >= 0.5) == F.col("y")).cast("double"))
    b = s.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.round(F.avg(inside.cast("int")), 9).alias("escalation"), F.round(F.avg(right), 9).alias("accuracy"))  # eleven rows
    order = Window.partitionBy(F.lit(0)).orderBy("escalation", F.desc("accuracy"), "i")
    front = b.withColumn("before", F.max("accuracy").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("before IS NULL OR accuracy > before")
    along = Window.partitionBy(F.lit(0)).orderBy("escalation")
    rise, run = F.col("accuracy") - F.lag("accuracy").over(along), F.col("escalation") - F.lag("escalation").over(along)
    k = front.select("i", F.when(run.isNull(), -1.0).when(run > 1e-9, rise / run).otherwise(0.0).alias("gain"))
    knee = k.agg(F.max_by("i", F.struct(F.round("gain", 9), -F.col("i"))).alias("band"), F.round(F.max("gain"), 6).alias("gain"))
    picks = b.agg(F.min_by("i", F.when(F.col("accuracy") >= 0.8, F.struct("escalation", "i"))).alias("cheapest_at_80"), F.max_by("i", F.when(F.col("escalation") <= 0.25, F.struct("accuracy", -F.col("i")))).alias("best_within_quarter"))
    return knee.crossJoin(picks)  # one row each


@query("""WITH c AS (SELECT cell_id, any_value(system) AS system, any_value(model) AS model, any_value(calls) AS calls, any_value(ok) AS ok, any_value(prompt_tokens + completion_tokens) AS t FROM result_cells GROUP BY cell_id) SELECT system, model, grouping(system, model)::BIGINT AS level, count(*) AS n, sum(calls)::BIGINT AS n_calls, sum(CASE WHEN calls > 0 THEN t ELSE 0 END)::BIGINT AS billable_tokens, round(avg((calls = 0)::INT), 6) AS hit_rate, count(*) FILTER (NOT ok) AS n_failed FROM c GROUP BY GROUPING SETS ((system), (model), ())""")
def call_totals(spark, sf_dir):
    """Calls, billable tokens, cache hits and failures per system, per model, and in all."""
    t = F.col("prompt_tokens") + F.col("completion_tokens")
    return cells(spark, sf_dir).groupingSets([["system"], ["model"], []], "system", "model").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("calls").alias("n_calls"), F.sum(F.when(F.col("calls") > 0, t).otherwise(0)).alias("billable_tokens"),
        F.round(F.avg((F.col("calls") == 0).cast("int")), 6).alias("hit_rate"), M.count_if(~F.col("ok")).alias("n_failed"))


@query(f"WITH {PAIRS}, t AS (SELECT temporal_cues_max >= 1 AS time_cue, opinion_cues_max >= 1 AS opinion_cue, exception_cues_max >= 1 AS exception_cue, {REL} AS relation FROM f) SELECT relation, count(*) AS n, count(*) FILTER (time_cue) AS n_time, count(*) FILTER (opinion_cue) AS n_opinion, count(*) FILTER (exception_cue) AS n_exception FROM t GROUP BY relation")
def scope_counters(spark, sf_dir):
    """Pairs per guessed relation, and the cues they carry."""
    f = _featured(spark, sf_dir)
    x = f.select("*", P.rule_relation({c: F.col(c) for c in FEATURES}).alias("relation"))
    return x.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), M.count_if(F.col("temporal_cues_max") >= 1).alias("n_time"), M.count_if(F.col("opinion_cues_max") >= 1).alias("n_opinion"), M.count_if(F.col("exception_cues_max") >= 1).alias("n_exception"))
