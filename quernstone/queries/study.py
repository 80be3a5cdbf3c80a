"""The study's measures: where gold stands, what retrieval and reduction leave of it, how answers and conditions fare."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import inference as I
from quernstone.operators import metrics as M
from quernstone.queries._registry import family
from quernstone.queries.evaluation import SCORES, _scores, cells
from quernstone.queries.text import PAGES, pages
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()


def conditions(answers: Column | str) -> Column:
    """The set of all conditions of an array of answers."""
    return F.array_distinct(F.flatten(F.transform(answers, lambda a: F.coalesce(a["conditions"], F.array().cast("array<string>")))))


def kind_of(answers: Column, not_answerable: Column) -> Column:
    return F.when(not_answerable | (F.size(answers) == 0), "unanswerable").when(F.exists(answers, lambda a: F.size(a["conditions"]) > 0), "conditional").otherwise("unconditional")


def questions(spark, sf_dir) -> DataFrame:
    """(qid, doc, answers, evidences, not_answerable, kind, co, ae): one row a question; its conditions, and evidence that is none."""
    q = table(spark, sf_dir, "questions").where("qid IS NOT NULL").dropDuplicates(["qid"]).select("qid", "doc", "answers", "evidences", F.coalesce("not_answerable", F.lit(False)).alias("na"))
    q = q.withColumn("kind", kind_of(F.col("answers"), F.col("na"))).withColumn("co", conditions("answers"))
    return q.withColumn("ae", F.array_except("evidences", "co"))


QK = """qq AS (SELECT qid, any_value(doc) AS doc, any_value(answers) AS ans, any_value(evidences) AS ev, coalesce(any_value(not_answerable), false) AS na FROM questions WHERE qid IS NOT NULL GROUP BY qid),
qk AS (SELECT *, CASE WHEN na OR len(ans) = 0 THEN 'unanswerable' WHEN len(co) > 0 THEN 'conditional' ELSE 'unconditional' END AS kind, list_filter(list_distinct(ev), lambda e: NOT list_contains(co, e)) AS ae
 FROM (SELECT *, list_distinct(flatten(list_transform(ans, lambda a: a.conditions))) AS co FROM qq))"""
YESNO = "list_filter(list_transform(ans, lambda a: lower(trim(a.answer))), lambda x: x IN ('yes', 'no'))"


@query(f"""WITH {QK} SELECT qid, kind, CASE WHEN kind = 'unanswerable' THEN 'none' WHEN len({YESNO}) > 0 THEN 'yesno' ELSE 'extractive' END AS answer_type, len(list_distinct({YESNO})) = 2 AS opposite, len(co) AS n_conditions, len(ae) AS n_answer_evidence FROM qk""")
def question_kinds(spark, sf_dir):
    """Stratum and answer type of each question, whether yes and no are both gold, its conditions and other evidence."""
    said = F.filter(F.transform("answers", lambda a: F.lower(F.trim(a["answer"]))), lambda x: x.isin("yes", "no"))
    kind = F.when(F.col("kind") == "unanswerable", "none").when(F.size(said) > 0, "yesno").otherwise("extractive")
    return questions(spark, sf_dir).select("qid", "kind", kind.alias("answer_type"), (F.size(F.array_distinct(said)) == 2).alias("opposite"), F.size("co").cast("bigint").alias("n_conditions"), F.size("ae").cast("bigint").alias("n_answer_evidence"))


LOCATED = f"""{PAGES}, {QK}, wanted AS (SELECT qid, doc, kind, unnest(co) AS el, 'condition' AS role FROM qk UNION ALL SELECT qid, doc, kind, unnest(ae), 'answer' FROM qk),
pe AS (SELECT doc, unnest(elements) AS raw, unnest(range(len(elements))) AS pos FROM pages), fc AS (SELECT DISTINCT chunk_id, doc, idx, el_start, el_end FROM chunks WHERE strategy = 'fixed'),
oc AS (SELECT w.*, pe.pos, fc.chunk_id, fc.idx, count(*) OVER (PARTITION BY qid, el) AS times FROM wanted w JOIN pe ON pe.doc = w.doc AND pe.raw = w.el JOIN fc ON fc.doc = w.doc AND pe.pos >= fc.el_start AND pe.pos < fc.el_end),
used AS (SELECT DISTINCT qid, chunk_id FROM oc WHERE times = 1),
rk AS (SELECT oc.*, row_number() OVER (PARTITION BY qid, el ORDER BY CASE WHEN u.chunk_id IS NULL THEN 1 ELSE 0 END, pos, idx) AS r FROM oc LEFT JOIN used u USING (qid, chunk_id)),
gl AS (SELECT qid, doc, kind, el, role, chunk_id, idx, pos FROM rk WHERE r = 1)"""


def located(spark, sf_dir) -> DataFrame:
    """(qid, doc, kind, el, role, chunk_id, idx, pos): each gold element in one fixed chunk of its page. An element that stands there
    more than once prefers a chunk that holds another gold element for certain, else its first place."""
    q = questions(spark, sf_dir)
    own = lambda c, r: q.select("qid", "doc", "kind", F.explode(c).alias("el"), F.lit(r).alias("role"))
    wanted = own("co", "condition").unionByName(own("ae", "answer"))
    e = pages(spark, sf_dir).select("doc", F.posexplode("elements").alias("pos", "el"))
    c = table(spark, sf_dir, "chunks").where("strategy = 'fixed'").select(F.col("doc").alias("d"), "chunk_id", "idx", "el_start", "el_end").distinct()
    oc = wanted.join(e, ["doc", "el"]).join(c, (F.col("doc") == F.col("d")) & (F.col("pos") >= F.col("el_start")) & (F.col("pos") < F.col("el_end"))).drop("d", "el_start", "el_end")
    oc = oc.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("qid", "el")))
    used = oc.where("times = 1").select("qid", "chunk_id").distinct().withColumn("u", F.lit(0))
    w = Window.partitionBy("qid", "el").orderBy(F.coalesce("u", F.lit(1)), "pos", "idx")
    return oc.join(used, ["qid", "chunk_id"], "left").withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "doc", "kind", "el", "role", "chunk_id", "idx", "pos")


SETS = """sets AS (SELECT qid, kind, coalesce(list_distinct(list(chunk_id) FILTER (role = 'answer')), []) AS a, coalesce(list_distinct(list(chunk_id) FILTER (role = 'condition')), []) AS c, list_distinct(list(chunk_id)) AS every FROM gl GROUP BY qid, kind)"""


def gold_sets(spark, sf_dir) -> DataFrame:
    """(qid, kind, a, c, every): chunks that hold answer evidence, conditions, either."""
    of = lambda r: F.coalesce(F.collect_set(F.when(F.col("role") == r, F.col("chunk_id"))), F.array())
    return located(spark, sf_dir).groupBy("qid", "kind").agg(of("answer").alias("a"), of("condition").alias("c"), F.collect_set("chunk_id").alias("every"))


@query(f"""WITH {LOCATED}, {SETS} SELECT kind, count(*) AS n, round(avg((len(every) > 1)::INT), 6) AS separated, round(avg(len(every)), 6) AS mean_gold_chunks,
round(avg((len(list_filter(c, lambda x: NOT list_contains(a, x))) > 0)::INT), 6) AS condition_only, round(avg((len(a) > 0 AND len(c) > 0 AND NOT list_has_any(a, c))::INT), 6) AS all_apart FROM sets GROUP BY kind""")
def gold_separation(spark, sf_dir):
    """How often the gold of a question does not fit in one chunk, and its conditions stand apart from the answer."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    s = gold_sets(spark, sf_dir)
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), share(F.size("every") > 1).alias("separated"), F.round(F.avg(F.size("every")), 6).alias("mean_gold_chunks"), share(F.size(F.array_except("c", "a")) > 0).alias("condition_only"), share((F.size("a") > 0) & (F.size("c") > 0) & ~F.arrays_overlap("a", "c")).alias("all_apart"))


# the ranking stored with the cells: of a question and ranker that of the first cell
RANKS = """ranked AS (SELECT qid, ranker, arg_min(chunks, cell_id) AS ch FROM result_cells WHERE chunks IS NOT NULL GROUP BY qid, ranker), ks AS (SELECT unnest([1, 2, 3, 5])::BIGINT AS k)"""


def stored_ranks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "result_cells").where("chunks IS NOT NULL").groupBy("qid", "ranker").agg(F.min_by("chunks", "cell_id").alias("ch"))


HITS = f"""{LOCATED}, {SETS}, {RANKS}, top AS (SELECT qid, ranker, k, kind, a, c, every, list_slice(ch, 1, k) AS t FROM sets JOIN ranked USING (qid), ks)"""
PART = lambda x: f"len(list_intersect({x}, t)) / nullif(len({x}), 0)"
ONLY = "list_filter(c, lambda x: NOT list_contains(a, x))"


def _tops(spark, sf_dir) -> DataFrame:
    return gold_sets(spark, sf_dir).join(stored_ranks(spark, sf_dir), "qid").withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 3, 5)]))).withColumn("t", F.slice("ch", F.lit(1), F.col("k").cast("int")))


@query(f"""WITH {HITS} SELECT ranker, k, count(*) AS n, round(avg({PART('a')}), 6) AS answer_recall, round(avg({PART('c')}), 6) AS condition_recall, round(avg({PART(ONLY)}), 6) AS condition_only_recall,
round(avg((len(list_intersect(c, t)) = len(c))::INT) FILTER (kind = 'conditional'), 6) AS all_conditions, round(avg((len(list_intersect(every, t)) = len(every))::INT), 6) AS all_gold,
round(avg((len(list_intersect(c, t)) < len(c))::INT) FILTER (kind = 'conditional' AND len(a) > 0 AND len(list_intersect(a, t)) = len(a)), 6) AS condition_lost_given_answer FROM top GROUP BY ranker, k""")
def retrieval_by_k(spark, sf_dir):
    """Of the chunks that hold the answer, the conditions, or conditions only, the share among the first k; and how often conditions
    are lost though the answer is found."""
    part = lambda c: F.try_divide(F.size(F.array_intersect(c, F.col("t"))), F.size(c))
    whole = lambda c: (F.size(F.array_intersect(F.col(c), F.col("t"))) == F.size(c))
    conditional = F.col("kind") == "conditional"
    share = lambda c, when=None: F.round(F.avg((F.when(when, c) if when is not None else c).cast("int")), 6)
    return _tops(spark, sf_dir).groupBy("ranker", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(part(F.col("a"))), 6).alias("answer_recall"), F.round(F.avg(part(F.col("c"))), 6).alias("condition_recall"), F.round(F.avg(part(F.array_except("c", "a"))), 6).alias("condition_only_recall"),
        share(whole("c"), conditional).alias("all_conditions"), share(whole("every")).alias("all_gold"), share(~whole("c"), conditional & (F.size("a") > 0) & whole("a")).alias("condition_lost_given_answer"),
    )


@query(f"""WITH {HITS}, r AS (SELECT ranker, list_distinct(list_slice(ch, 1, 5)) AS shown, list_distinct(list_slice(ch, 1, 2)) AS kept, a, c FROM sets JOIN ranked USING (qid)),
s AS (SELECT *, list_filter(shown, lambda x: NOT list_contains(kept, x)) AS dropped FROM r) SELECT ranker, count(*) AS n, round(avg((len(dropped) > 0)::INT), 6) AS changed, round(avg(len(kept)), 6) AS mean_kept,
round(sum(len(list_intersect(c, dropped))) / nullif(sum(len(list_intersect(c, shown))), 0), 6) AS condition_dropped, round(sum(len(list_intersect(a, dropped))) / nullif(sum(len(list_intersect(a, shown))), 0), 6) AS answer_dropped FROM s GROUP BY ranker""")
def reduction_survival(spark, sf_dir):
    """What keeping the first two of five chunks drops of the gold that was shown."""
    s = gold_sets(spark, sf_dir).join(stored_ranks(spark, sf_dir), "qid").select("ranker", F.array_distinct(F.slice("ch", 1, 5)).alias("shown"), F.array_distinct(F.slice("ch", 1, 2)).alias("kept"), "a", "c")
    s = s.withColumn("dropped", F.array_except("shown", "kept"))
    lost = lambda c: F.round(F.try_divide(F.sum(F.size(F.array_intersect(c, "dropped"))), F.sum(F.size(F.array_intersect(c, "shown")))), 6)
    return s.groupBy("ranker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.size("dropped") > 0).cast("int")), 6).alias("changed"), F.round(F.avg(F.size("kept")), 6).alias("mean_kept"), lost("c").alias("condition_dropped"), lost("a").alias("answer_dropped"))


TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '[ \t\n\r\f\x0B]+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
BAG = lambda a, b: f"list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w)))))"
QS = f"""{QK}, cl AS (SELECT cell_id, any_value(qid) AS qid, any_value(system) AS system, any_value(model) AS model, any_value(answers) AS given, any_value(ok) AS ok, any_value(prompt_tokens) AS pt, any_value(completion_tokens) AS ct, any_value(latency_s) AS lat, any_value(served_by) AS served_by, any_value(chunks) AS chunks, any_value(evidence) AS used, any_value(strategy) AS strategy, any_value(words) AS words FROM result_cells GROUP BY cell_id),
s0 AS (SELECT cell_id, qid, system, model, kind, served_by, ok, pt, ct, lat, used, co, ae, list_distinct(flatten(list_transform(given, lambda a: a.conditions))) AS pc, len(given) AS n_answers, {TOKENS.format("coalesce(given[1].answer, '')")} AS tp, {TOKENS.format("coalesce(ans[1].answer, '')")} AS tg FROM cl JOIN qk USING (qid)),
qs AS (SELECT *, len(list_intersect(pc, co)) AS n_correct, len(pc) AS n_pred, len(co) AS n_gold, CASE WHEN len(tp) = 0 OR len(tg) = 0 THEN (len(tp) = len(tg))::INT ELSE 2 * coalesce({BAG('tp', 'tg')}, 0) / (len(tp) + len(tg)) END AS f1 FROM s0)"""


def scored_cells(spark, sf_dir) -> DataFrame:
    """Cells with their question: F1 of the first answer, and counts of stated, gold and common conditions."""
    from quernstone.functions import text as T

    q = questions(spark, sf_dir).select("qid", "kind", "co", "ae", F.get("answers", F.lit(0))["answer"].alias("g"))
    c = cells(spark, sf_dir).select("cell_id", "qid", "system", "model", "served_by", "ok", "prompt_tokens", "completion_tokens", "latency_s", F.col("evidence").alias("used"), F.col("answers").alias("given"))
    normal = lambda x: F.filter(F.split(T.squad_normal(F.coalesce(x, F.lit(""))), " "), lambda w: w != "")
    d = c.join(q, "qid").select("*", conditions("given").alias("pc"), normal(F.get("given", F.lit(0))["answer"]).alias("tp"), normal(F.col("g")).alias("tg"), F.size("given").alias("n_answers"))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct("tp"), F.lit(0), lambda s, w: s + F.least(count("tp", w), count("tg", w)))
    blank = (F.size("tp") == 0) | (F.size("tg") == 0)
    f1 = F.when(blank, (F.size("tp") == F.size("tg")).cast("double")).otherwise(2 * common / (F.size("tp") + F.size("tg")))
    return d.select("*", F.size(F.array_intersect("pc", "co")).alias("n_correct"), F.size("pc").alias("n_pred"), F.size("co").alias("n_gold"), f1.alias("f1"))


SUMMARY = """count(*) AS n, round(avg(f1), 6) AS f1, round(sum(n_correct) / nullif(sum(n_pred), 0), 6) AS cond_precision, round(sum(n_correct) / nullif(sum(n_gold), 0), 6) AS cond_recall,
round(avg((n_pred > 0)::INT), 6) AS any_condition, round(avg((n_answers = 0)::INT), 6) AS no_answer, round(avg(ok::INT), 6) AS parse_ok, round(avg(pt + ct), 6) AS tokens"""


def _summary() -> list[Column]:
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    pooled = lambda c: F.round(F.try_divide(F.sum("n_correct"), F.sum(c)), 6)
    return [
        F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("f1"), pooled("n_pred").alias("cond_precision"), pooled("n_gold").alias("cond_recall"), share(F.col("n_pred") > 0).alias("any_condition"),
        share(F.col("n_answers") == 0).alias("no_answer"), share(F.col("ok")).alias("parse_ok"), F.round(F.avg(F.col("prompt_tokens") + F.col("completion_tokens")), 6).alias("tokens"),
    ]


@query(f"WITH {QS} SELECT system, model, coalesce(kind, 'all') AS kind, {SUMMARY} FROM qs GROUP BY GROUPING SETS ((system, model, kind), (system, model))")
def end_to_end(spark, sf_dir):
    """Means of each system and model, per kind of question and over all: conditions pooled, null where a denominator is 0."""
    return scored_cells(spark, sf_dir).groupingSets([["system", "model", "kind"], ["system", "model"]], "system", "model", "kind").agg(*_summary()).withColumn("kind", F.coalesce("kind", F.lit("all")))


ERROR = """CASE WHEN f1 < 0.5 THEN 'answer_wrong' WHEN kind <> 'conditional' THEN CASE WHEN n_pred > 0 THEN 'spurious_condition' ELSE 'no_condition_needed' END WHEN n_pred = 0 THEN 'condition_omitted' WHEN n_correct = 0 THEN 'wrong_condition' WHEN n_correct >= n_gold THEN 'all_conditions' ELSE 'partial_conditions' END"""


@query(f"WITH {QS}, e AS (SELECT system, {ERROR} AS error FROM qs WHERE kind <> 'unanswerable') SELECT system, error, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY system), 6) AS share FROM e GROUP BY system, error")
def error_taxonomy(spark, sf_dir):
    """Share of answerable questions in each of seven error classes; a wrong answer is never blamed on its conditions."""
    plain = F.when(F.col("n_pred") > 0, "spurious_condition").otherwise("no_condition_needed")
    e = F.when(F.col("f1") < 0.5, "answer_wrong").when(F.col("kind") != "conditional", plain).when(F.col("n_pred") == 0, "condition_omitted").when(F.col("n_correct") == 0, "wrong_condition").when(F.col("n_correct") >= F.col("n_gold"), "all_conditions").otherwise("partial_conditions")
    n = scored_cells(spark, sf_dir).where("kind <> 'unanswerable'").groupBy("system", e.alias("error")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("system", "error", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("system")), 6).alias("share"))


@query(f"WITH {QS} SELECT system, count(*) AS n, sum(len(list_filter(co, lambda x: NOT list_contains(pc, x))))::BIGINT AS n_missed, sum(len(list_filter(pc, lambda x: NOT list_contains(co, x))))::BIGINT AS n_wrong, sum(n_correct)::BIGINT AS n_correct, sum(len(list_filter(co, lambda x: list_contains(used, x) AND NOT list_contains(pc, x))))::BIGINT AS n_only_cited FROM qs GROUP BY system")
def missed_and_stated(spark, sf_dir):
    """Conditions missed, stated wrongly, stated rightly, and cited as evidence without being stated."""
    total = lambda c: F.sum(F.size(c)).cast("bigint")
    return scored_cells(spark, sf_dir).groupBy("system").agg(F.count(F.lit(1)).alias("n"), total(F.array_except("co", "pc")).alias("n_missed"), total(F.array_except("pc", "co")).alias("n_wrong"), F.sum("n_correct").alias("n_correct"), total(F.array_except(F.array_intersect("co", "used"), "pc")).alias("n_only_cited"))


@query(f"WITH {QS}, p AS (SELECT DISTINCT qs.cell_id, m AS missed, s AS stated FROM qs, unnest(list_filter(co, lambda x: NOT list_contains(pc, x))) a(m), unnest(list_filter(pc, lambda x: NOT list_contains(co, x))) b(s)) SELECT stated, missed, count(*) AS n_cells FROM p GROUP BY ALL")
def stated_for_missed(spark, sf_dir):
    """Each wrongly stated condition with each missed one of its cell: the candidates of a semantic audit."""
    p = scored_cells(spark, sf_dir).select("cell_id", F.explode(F.array_except("co", "pc")).alias("missed"), F.array_except("pc", "co").alias("s")).select("cell_id", "missed", F.explode("s").alias("stated")).distinct()
    return p.groupBy("stated", "missed").agg(F.count(F.lit(1)).alias("n_cells"))


@query(f"WITH {QS}, p AS (SELECT coalesce(served_by, 'unknown') AS served_by, split_part(coalesce(served_by, 'unknown'), '-', 1) AS prefix, f1, ok FROM qs) SELECT served_by, prefix, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(count(*)) OVER (PARTITION BY prefix) / sum(count(*)) OVER (), 6) AS prefix_share, round(avg(f1), 6) AS f1 FROM p GROUP BY served_by, prefix")
def provider_shares(spark, sf_dir):
    """Cells and F1 of each provider, and the share of its family."""
    by = F.coalesce("served_by", F.lit("unknown"))
    n = scored_cells(spark, sf_dir).groupBy(by.alias("served_by"), F.split_part(by, F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("f1"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each provider
    return n.select("served_by", "prefix", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(F.sum("n").over(Window.partitionBy("prefix")) / total, 6).alias("prefix_share"), "f1")


@query(f"WITH {QS} SELECT model, count(*) AS n, count(*) FILTER (pt + ct >= 0.9 * 3000) AS n_near_window, max(pt)::BIGINT AS most_prompt, count(*) FILTER (pt > 3000) AS n_over FROM qs GROUP BY model")
def window_limits(spark, sf_dir):
    """Cells near a context window of 3,000 tokens, and the longest prompt."""
    t = F.col("prompt_tokens") + F.col("completion_tokens")
    return scored_cells(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), M.count_if(t >= 0.9 * 3000).alias("n_near_window"), F.max("prompt_tokens").alias("most_prompt"), M.count_if(F.col("prompt_tokens") > 3000).alias("n_over"))


@query(f"WITH {QS}, v AS (SELECT model, system, avg(f1) AS f1, avg(n_pred) AS np FROM qs GROUP BY ALL) SELECT model, count(*) AS n_variants, round(min(f1), 6) AS least_f1, round(max(f1), 6) AS most_f1, arg_max(system, (round(f1, 9), system)) AS best, round(max(f1) - min(f1), 6) AS spread FROM v GROUP BY model")
def variant_spread(spark, sf_dir):
    """Least and greatest mean F1 of a model over its systems: aggregates of aggregates."""
    v = scored_cells(spark, sf_dir).groupBy("model", "system").agg(F.avg("f1").alias("f1"))
    return v.groupBy("model").agg(F.count(F.lit(1)).alias("n_variants"), F.round(F.min("f1"), 6).alias("least_f1"), F.round(F.max("f1"), 6).alias("most_f1"), F.max_by("system", F.struct(F.round("f1", 9), "system")).alias("best"), F.round(F.max("f1") - F.min("f1"), 6).alias("spread"))


@query(f"""WITH {SCORES}, a AS (SELECT system, max(np)::DOUBLE AS p, max(nn)::DOUBLE AS n, sum(pos * (nn - fp) + 0.5 * pos * neg) / max(np * nn) AS a FROM tt GROUP BY system HAVING max(np * nn) > 0),
b AS (SELECT system, a, sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)) AS se FROM a) SELECT system, round(a, 6) AS auc, round(a - 1.96 * se, 6) AS low, round(a + 1.96 * se, 6) AS high FROM b""")
def auc_intervals(spark, sf_dir):
    """AUC of each system with its closed-form interval."""
    t = M.threshold_table(_scores(spark, sf_dir), "score", "label", ["system"])
    wins = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg"))
    a = t.groupBy("system").agg(F.max("n_pos").cast("double").alias("p"), F.max("n_neg").cast("double").alias("n"), wins.alias("w")).where("p * n > 0").withColumn("a", F.col("w") / (F.col("p") * F.col("n")))
    low, high = I.auc_interval(F.col("a"), F.col("p"), F.col("n"))
    return a.select("system", F.round("a", 6).alias("auc"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


GRID = f"""{SCORES}, g AS (SELECT round(unnest(range(1, 20)) * 0.05, 2) AS t), fs AS (SELECT cell_id % 5 AS fold, round(ct::DOUBLE / (pt + ct), 3) AS score, bad > 0 AS label FROM c),
"""


def _folded(spark, sf_dir) -> DataFrame:
    s = F.round(F.col("completion_tokens") / (F.col("prompt_tokens") + F.col("completion_tokens")), 3)
    return cells(spark, sf_dir).select("cell_id", "system", s.alias("score"), (F.col("bad_citations") > 0).alias("label"), (F.col("cell_id") % 5).alias("fold"))


@query("WITH " + GRID + """e AS (SELECT fold, g.t, count(*) FILTER (label AND score >= g.t) AS tp, count(*) FILTER (NOT label AND score >= g.t) AS fp, count(*) FILTER (label AND score < g.t) AS fn FROM fs, g GROUP BY ALL),
f AS (SELECT fold, t, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM e) SELECT fold, arg_max(t, (f1, -t)) AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY fold""")
def fold_thresholds(spark, sf_dir):
    """The threshold of a grid of nineteen with the best F1 in each fold, of equal ones the lower; the grid is a small array."""
    t = F.round(F.col("i") * 0.05, 2)
    e = _folded(spark, sf_dir).select("fold", "score", "label", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("i")).select("fold", "score", "label", t.alias("t"))
    e = e.groupBy("fold", "t").agg(M.count_if(F.col("label") & (F.col("score") >= F.col("t"))).alias("tp"), M.count_if(~F.col("label") & (F.col("score") >= F.col("t"))).alias("fp"), M.count_if(F.col("label") & (F.col("score") < F.col("t"))).alias("fn"))
    f1 = F.round(M.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)
    return e.withColumn("f1", f1).groupBy("fold").agg(F.max(F.struct("f1", -F.col("t"))).alias("b")).select("fold", (-F.col("b.col2")).alias("threshold"), F.round("b.f1", 6).alias("f1"))


@query(f"""WITH {QK} SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(['all', kind, CASE WHEN len({YESNO}) > 0 THEN 'yesno' END, CASE WHEN len(list_distinct({YESNO})) = 2 THEN 'opposite' END, CASE WHEN kind <> 'unanswerable' THEN 'answerable' END], lambda x: x IS NOT NULL)) AS name FROM qk) GROUP BY name""")
def populations(spark, sf_dir):
    """Sizes of the named populations of questions."""
    said = F.filter(F.transform("answers", lambda a: F.lower(F.trim(a["answer"]))), lambda x: x.isin("yes", "no"))
    names = F.array_compact(F.array(F.lit("all"), "kind", F.when(F.size(said) > 0, "yesno"), F.when(F.size(F.array_distinct(said)) == 2, "opposite"), F.when(F.col("kind") != "unanswerable", "answerable")))
    return questions(spark, sf_dir).select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {QS}, m AS (SELECT qid, system, avg(f1) AS f FROM qs GROUP BY ALL), p AS (SELECT a.system AS a, b.system AS b, a.f - b.f AS d FROM m a JOIN m b ON a.qid = b.qid AND a.system < b.system), n AS (SELECT system, count(*) AS n FROM m GROUP BY system)
SELECT p.a, p.b, count(*) AS n_pairs, round(avg(d), 6) AS mean_difference, count(*) FILTER (d > 1e-12) AS n_a_better, count(*) FILTER (d < -1e-12) AS n_b_better, count(*) = any_value(na.n) AND count(*) = any_value(nb.n) AS complete FROM p JOIN n na ON na.system = p.a JOIN n nb ON nb.system = p.b GROUP BY p.a, p.b""")
def paired_systems(spark, sf_dir):
    """Every two systems on the questions both answered: mean difference in F1, and whether both answered the same ones."""
    m = scored_cells(spark, sf_dir).groupBy("qid", "system").agg(F.avg("f1").alias("f"))
    n = m.groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    a, b = m.select("qid", F.col("system").alias("a"), F.col("f").alias("fa")), m.select("qid", F.col("system").alias("b"), F.col("f").alias("fb"))
    p = a.join(b, "qid").where("a < b").withColumn("d", F.col("fa") - F.col("fb"))  # a question has a row for each system
    g = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("d"), 6).alias("mean_difference"), M.count_if(F.col("d") > 1e-12).alias("n_a_better"), M.count_if(F.col("d") < -1e-12).alias("n_b_better"))
    own = lambda c: n.select(F.col("system").alias(c), F.col("n").alias(f"n_{c}"))
    return g.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_pairs", "mean_difference", "n_a_better", "n_b_better", ((F.col("n_pairs") == F.col("n_a")) & (F.col("n_pairs") == F.col("n_b"))).alias("complete"))


@query(f"""WITH {QS}, r AS (SELECT system, pt + ct AS t, lat, row_number() OVER (PARTITION BY system ORDER BY pt + ct, cell_id) AS i, count(*) OVER (PARTITION BY system) AS n, row_number() OVER (PARTITION BY system ORDER BY lat NULLS LAST, cell_id) AS li, count(lat) OVER (PARTITION BY system) AS ln FROM qs)
SELECT system, round(avg(t), 6) AS mean_tokens, max(CASE WHEN i = ceil(0.9 * n) THEN t END)::BIGINT AS p90_tokens, round(max(CASE WHEN li - 1 = round_even(0.5 * (ln - 1), 0) THEN lat END), 6) AS p50_latency, round(max(CASE WHEN li - 1 = round_even(0.95 * (ln - 1), 0) THEN lat END), 6) AS p95_latency, count(*) FILTER (lat < 0.01) AS n_instant FROM r GROUP BY system""")
def cost_and_latency(spark, sf_dir):
    """Tokens and latency by rank: the 90th percentile at rank ceil(0.9 n), others at round(p (n - 1)) with halves to even."""
    s = scored_cells(spark, sf_dir).select("system", "cell_id", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("t"), "latency_s")
    part = Window.partitionBy("system")
    s = s.withColumn("i", F.row_number().over(part.orderBy("t", "cell_id"))).withColumn("n", F.count(F.lit(1)).over(part)).withColumn("li", F.row_number().over(part.orderBy(F.asc_nulls_last("latency_s"), "cell_id"))).withColumn("ln", F.count("latency_s").over(part))
    at = lambda p: F.round(F.max(F.when(F.col("li") - 1 == F.bround(F.lit(p) * (F.col("ln") - 1), 0), F.col("latency_s"))), 6)
    return s.groupBy("system").agg(F.round(F.avg("t"), 6).alias("mean_tokens"), F.max(F.when(F.col("i") == F.ceil(F.lit(0.9) * F.col("n")), F.col("t"))).alias("p90_tokens"), at(0.5).alias("p50_latency"), at(0.95).alias("p95_latency"), M.count_if(F.col("latency_s") < 0.01).alias("n_instant"))
