"""Answers and branches against gold."""
from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import outcomes as O
from quernstone.functions import text as T
from quernstone.operators import matching as X
from quernstone.plans.components import components
from quernstone.plans.materialize import materialize
from quernstone.queries._registry import family
from quernstone.queries.evaluation import Q, scored
from quernstone.queries.pairs import CONTENT
from quernstone.queries.scope import BR, branches
from quernstone.queries.text import DOCS, SENTENCES, documents
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()
SENT_CTES = SENTENCES[len(DOCS) + 2 :]

def chain(c: str, steps: list[tuple[str, str]]) -> str:
    """SQL of replacements one after the other."""
    for pattern, by in steps:
        p = pattern.replace("'", "''")
        c = f"regexp_replace({c}, '{p}', '{by}', 'g')"
    return c


STEPS = lambda c: chain(c, O.number_steps())
LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
OTOK = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda w: NOT list_contains({LIST(X.EMPTY_WORDS)}, w)))"
ONUM = lambda c: f"list_distinct(list_transform(regexp_extract_all({STEPS(f'lower({c})')}, '\\d+(?:[.,]\\d+)?\\s*%?'), lambda x: rtrim(x)))"
CANON = lambda c: chain(STEPS("trim(lower(" + chain(c, [(O.CITATION, "")]) + "))"), O.canonical_steps())
CITED = O.CITATION
COUNTED = lambda c: f"""list_distinct(list_transform(regexp_extract_all({c}, '{O.FIGURE}'), lambda m: concat_ws(' ', CASE WHEN regexp_matches(m, '^\\d+(?:\\.\\d+)?\\s*%') THEN '%' ELSE coalesce(list_filter(list_transform(list_slice(regexp_extract_all(m, '[a-z]+'), 1, 2), lambda w: regexp_replace(w, 's$', '')), lambda w: list_contains({LIST(O.UNITS)}, w))[1], 'amount') END, regexp_extract(m, '^\\d+(?:\\.\\d+)?'))))"""


def match_sql(table: str, keep: str) -> str:
    """CTEs om_0 to om: of the columns g and p of ``table``, whether they match (m)."""
    bare = lambda c: f"regexp_replace({c}, '{X.BOUND}', ' ', 'g')"
    neg = LIST(X.NEGATORS)
    return f"""om_0 AS (SELECT {keep}, g, p, {OTOK('g')} AS tg, {OTOK('p')} AS tp, {OTOK(bare('g'))} AS bg, {OTOK(bare('p'))} AS bp, {ONUM('g')} AS ng, {ONUM('p')} AS np FROM {table}),
om_1 AS (SELECT *, list_filter(bg, lambda w: NOT list_contains({neg}, w)) AS cg, list_filter(bp, lambda w: NOT list_contains({neg}, w)) AS cp FROM om_0),
om AS (SELECT *, NOT (len(ng) > 0 AND len(np) > 0 AND NOT list_has_any(ng, np)) AND NOT ((len(bg) - len(cg)) % 2 <> (len(bp) - len(cp)) % 2 AND least(len(cg), len(cp)) > 0 AND len(list_intersect(cg, cp)) >= 0.6 * least(len(cg), len(cp)))
 AND (coalesce(len(list_intersect(tg, tp)) / nullif(len(list_distinct(list_concat(tg, tp))), 0), 0) >= 0.45 OR coalesce(len(list_intersect(tg, tp)) / nullif(len(tg), 0), 0) >= 0.6) AS m FROM om_1)"""


NORMAL = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '[ \t\n\r\f\x0B]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"""
FIRSTS = f"{Q}, a AS (SELECT cell_id, system, coalesce(gold[1].answer, '') AS g, coalesce(answers[1].answer, '') AS p FROM c JOIN q USING (qid) WHERE len(gold) > 0 AND len(answers) > 0)"


def _firsts(spark, sf_dir):
    s = scored(spark, sf_dir).where("size(gold) > 0 AND size(answers) > 0")
    return s.select("cell_id", "system", F.coalesce(F.get("gold", F.lit(0))["answer"], F.lit("")).alias("g"), F.coalesce(F.get("answers", F.lit(0))["answer"], F.lit("")).alias("p"))


@query(f"WITH {FIRSTS}, {match_sql('a', 'cell_id, system')} SELECT system, count(*) AS n, count(*) FILTER (m) AS n_match FROM om GROUP BY system")
def outcome_matches(spark, sf_dir):
    """First answers that say the same as the first gold answer, figures and negations vetoing."""
    return _firsts(spark, sf_dir).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum(X.outcomes_match(F.col("g"), F.col("p")).cast("bigint")).alias("n_match"))


@query(f"""WITH d AS (SELECT DISTINCT g AS x FROM (SELECT b.outcome AS g FROM (SELECT unnest(gold_branches) AS b FROM gold_instances) UNION ALL SELECT a.answer FROM (SELECT unnest(answers) AS a FROM questions)) WHERE g IS NOT NULL)
SELECT x AS outcome, {CANON('x')} AS canonical, array_to_string(list_sort({COUNTED(CANON('x'))}), ', ') AS figures FROM d""")
def canonical_outcomes(spark, sf_dir):
    """Outcomes of branches and gold answers in their common form, with their figures by what they count."""
    b = table(spark, sf_dir, "gold_instances").select(F.explode("gold_branches.outcome").alias("outcome"))
    d = b.unionByName(table(spark, sf_dir, "questions").select(F.explode("answers.answer").alias("outcome"))).where("outcome IS NOT NULL").distinct()
    c = d.withColumn("canonical", O.canonical_outcome(F.col("outcome")))
    return c.select("outcome", "canonical", F.array_join(F.array_sort(O.counted_figures(F.col("canonical"))), ", ").alias("figures"))


@query(f"""WITH {FIRSTS}, k AS (SELECT DISTINCT g AS g0, p AS p0, {CANON('g')} AS g, {CANON('p')} AS p FROM a), h AS (SELECT *, {COUNTED('g')} AS fg, {COUNTED('p')} AS fp FROM k), {match_sql('k', 'g0, p0')},
v AS (SELECT g0, p0, len(list_filter(list_intersect(list_transform(fg, lambda x: split_part(x, ' ', 1)), list_transform(fp, lambda x: split_part(x, ' ', 1))), lambda y: NOT list_has_any(list_filter(fg, lambda x: split_part(x, ' ', 1) = y), list_filter(fp, lambda x: split_part(x, ' ', 1) = y)))) > 0 AS clash FROM h)
SELECT system, count(*) AS n, count(*) FILTER (om.m AND NOT clash AND trim(a.g) <> '' AND trim(a.p) <> '') AS n_match, count(*) FILTER (clash) AS n_clash FROM a JOIN om ON a.g = g0 AND a.p = p0 JOIN v ON v.g0 = a.g AND v.p0 = a.p GROUP BY system""")
def value_matches(spark, sf_dir):
    """First answers that match the first gold answer in their common forms, and those whose figures for one thing differ."""
    d = _firsts(spark, sf_dir)
    pairs = d.select("g", "p").distinct()  # each text is rewritten once, each pair of texts compared once
    texts = pairs.select(F.explode(F.array("g", "p")).alias("t")).distinct().withColumn("c", O.canonical_outcome(F.col("t")))
    texts = materialize(texts.withColumn("f", O.counted_figures(F.col("c"))), "outcomes")
    own = lambda k: texts.select(F.col("t").alias(k), F.col("c").alias(f"c{k}"), F.col("f").alias(f"f{k}"))
    both = pairs.join(own("g"), "g").join(own("p"), "p").withColumn("clash", O.counts_conflict(F.col("fg"), F.col("fp")))
    said = (F.trim("g") != "") & (F.trim("p") != "")
    pairs = both.select("g", "p", (said & ~F.col("clash") & X.outcomes_match(F.col("cg"), F.col("cp"))).alias("m"), "clash")
    return d.join(pairs, ["g", "p"]).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m").cast("bigint")).alias("n_match"), F.sum(F.col("clash").cast("bigint")).alias("n_clash"))


BARE = lambda c: f"list_filter(string_split_regex(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
BAGF1 = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN (len({a}) = len({b}))::INT ELSE 2 * coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0) / (len({a}) + len({b})) END"
AT = lambda m, i, j: f"coalesce(max({m}) FILTER (i = {i} AND j = {j}), 0)"
# answers and gold answers are two at most in these tables: the best of both ways to pair them
TWO = lambda m: f"greatest({AT(m, 1, 1)} + {AT(m, 2, 2)}, {AT(m, 1, 2)} + {AT(m, 2, 1)}, {AT(m, 1, 1)}, {AT(m, 1, 2)}, {AT(m, 2, 1)}, {AT(m, 2, 2)})"


@query(f"""WITH {Q}, s AS (SELECT cell_id, system, na, coalesce(answers, []) AS p, coalesce(gold, []) AS g FROM c JOIN q USING (qid)), x AS (SELECT cell_id, i, j, {BARE("coalesce(p[i].answer, '')")} AS tp, {BARE("coalesce(g[j].answer, '')")} AS tg, list_distinct(coalesce(p[i].conditions, [])) AS cp, list_distinct(coalesce(g[j].conditions, [])) AS cg FROM s, range(1, 3) r(i), range(1, 3) t(j) WHERE i <= len(p) AND j <= len(g)),
m AS (SELECT cell_id, i, j, (tp = tg)::INT AS em, {BAGF1('tp', 'tg')} AS f1, {BAGF1('cp', 'cg')} AS c FROM x), b AS (SELECT cell_id, {TWO('em')} AS em, {TWO('em * c')} AS emc, {TWO('f1')} AS f1, {TWO('f1 * c')} AS f1c FROM m GROUP BY cell_id),
z AS (SELECT system, CASE WHEN na THEN 'unanswerable' ELSE 'answerable' END AS kind, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT ELSE coalesce(em, 0) / len(g) * k END AS em, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT ELSE coalesce(emc, 0) / len(g) * k END AS emc, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT ELSE coalesce(f1, 0) / len(g) * k END AS f1, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT ELSE coalesce(f1c, 0) / len(g) * k END AS f1c
 FROM (SELECT s.*, CASE WHEN len(g) > 0 AND len(p) > len(g) THEN exp(1 - len(p) / len(g)) ELSE 1 END AS k FROM s) LEFT JOIN b USING (cell_id)) SELECT system, kind, count(*) AS n, round(avg(em), 6) AS em, round(avg(emc), 6) AS em_conditions, round(avg(f1), 6) AS f1, round(avg(f1c), 6) AS f1_conditions FROM z GROUP BY system, kind""")
def conditional_answer_scores(spark, sf_dir):
    """EM and F1 with and without conditions per system: the best assignment a row (tested by hand)."""
    s = scored(spark, sf_dir)
    per = X.scored_answers(s.select("cell_id", "answers", "gold"), "cell_id").join(s.select("cell_id", "system", "na"), "cell_id")
    kind = F.when(F.col("na"), "unanswerable").otherwise("answerable")
    return per.groupBy("system", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("em", "em_conditions", "f1", "f1_conditions")])


# an instance has two branches at most in these tables, so one pair
@query(f"""WITH {BR}, p AS (SELECT a.instance_id, a.bid AS a, b.bid AS b, {CONTENT.format("coalesce(a.outcome, '')")} AS ta, {CONTENT.format("coalesce(b.outcome, '')")} AS tb FROM br a JOIN br b ON a.instance_id = b.instance_id AND a.bid < b.bid), s AS (SELECT instance_id, a, b, round(coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(list_concat(ta, tb))), 0), 0), 9) AS score FROM p) SELECT * FROM s WHERE score >= 0.25""")
def branch_alignment(spark, sf_dir):
    """Branches of one instance aligned with those of the next of its query by outcome, one to one, best first."""
    b = branches(spark, sf_dir).select("instance_id", "branch_id", T.content_tokens(F.coalesce("outcome", F.lit(""))).alias("t"))
    a = b.select("instance_id", F.col("branch_id").alias("a"), F.col("t").alias("ta"))
    p = a.join(b, "instance_id").where("a < branch_id").select("instance_id", "a", F.col("branch_id").alias("b"), F.round(T.jaccard(F.col("ta"), F.col("t")), 9).alias("score"))
    return X.greedy_alignment(p, "instance_id", "a", "b", "score", 0.25)


# text, and whether the first "may" is there, is negated, is followed by what, and preceded by which two words
MAY_SQL = f"""{O.MAY[4:]}"""
MODAL = f"""ms AS (SELECT DISTINCT x, {chain("coalesce(x, '')", [(O.CITATION, '')])} AS s FROM src),
mw AS (SELECT x, s, regexp_matches(s, '{O.MAY}') AS has, regexp_extract(s, '{O.MAY}', 1) <> '' AS neg, lower(regexp_extract(s, '{O.MAY}', 2)) AS nxt, regexp_extract_all(lower(regexp_extract(s, '(?is)^(.*?){MAY_SQL}', 1)), '[a-z'']+') AS bf FROM ms),
mm AS (SELECT *, CASE WHEN NOT has THEN 'none' WHEN NOT neg AND list_has_any(list_slice(bf, greatest(len(bf) - 1, 1), len(bf)), {LIST(O.OPEN_SUBJECTS)}) THEN 'hedged' WHEN neg THEN CASE WHEN list_contains({LIST(O.LEFT_OPEN)}, nxt) THEN 'hedged' ELSE 'prohibition' END WHEN list_contains({LIST(O.HAPPENS)}, nxt) THEN 'hedged' ELSE 'permission' END AS may FROM mw),
md AS (SELECT x, CASE WHEN trim(s) = '' OR regexp_matches(s, '{O.HEDGE}') OR may = 'hedged' THEN 'hedged' WHEN may = 'prohibition' OR regexp_matches(s, '{O.PROHIBITION.replace("'", "''")}') THEN 'prohibition' WHEN regexp_matches(s, '{O.OBLIGATION}') THEN 'obligation' WHEN may = 'permission' OR regexp_matches(s, '{O.PERMISSION}') THEN 'permission' ELSE 'statement' END AS modality FROM mm)"""


@query(f"""WITH e AS (SELECT DISTINCT cell_id, a.answer AS s FROM (SELECT cell_id, unnest(answers) AS a FROM result_cells)), src AS (SELECT coalesce(s, '') AS x FROM e), {MODAL} SELECT modality, count(*) AS n FROM e JOIN md ON coalesce(s, '') = x GROUP BY modality""")
def answer_modality(spark, sf_dir):
    """What kind of statement answers are."""
    a = table(spark, sf_dir, "result_cells").select("cell_id", F.explode("answers").alias("a")).select("cell_id", F.col("a.answer").alias("s")).distinct()
    return a.groupBy(O.modality(F.col("s")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DOCS}, {SENT_CTES}, src AS (SELECT s AS x FROM sents), {MODAL} SELECT source, modality, count(*) AS n FROM sents JOIN md ON s = x GROUP BY ALL""")
def sentence_modality(spark, sf_dir):
    """Modality of every sentence of every document, per source."""
    d = documents(spark, sf_dir).select("source", F.explode(T.sentences(F.col("text"))).alias("s"))
    return d.groupBy("source", O.modality(F.col("s")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc, arg_max(elements, fetched_at) AS els FROM guide_docs GROUP BY doc), q AS (SELECT qid, any_value(doc) AS doc, list_distinct(any_value(evidences)) AS ev FROM questions GROUP BY qid),
e AS (SELECT DISTINCT qid, doc, unnest(ev) AS el FROM q), l AS (SELECT e.qid, e.el, list_position(els, el) - 1 AS pos, len(list_filter(els, lambda x: x = el)) AS times FROM e JOIN p USING (doc)),
c AS (SELECT DISTINCT chunk_id, doc, el_start, el_end FROM chunks WHERE strategy = 'fixed'), g AS (SELECT l.qid, l.pos, l.times, c.chunk_id FROM l JOIN q USING (qid) LEFT JOIN c ON c.doc = q.doc AND l.pos >= c.el_start AND l.pos < c.el_end)
SELECT qid, count(*) AS n_evidence, count(DISTINCT chunk_id) AS n_chunks, count(*) FILTER (pos IS NULL) AS n_unlocated, count(*) FILTER (times > 1) AS n_ambiguous FROM g GROUP BY qid""")
def locate_gold(spark, sf_dir):
    """Evidence elements located on their page and in its fixed chunks: spread, unlocated, ambiguous."""
    from quernstone.queries.text import pages

    q = table(spark, sf_dir, "questions").dropDuplicates(["qid"]).select("qid", "doc", F.explode(F.array_distinct("evidences")).alias("el"))
    at = F.array_position("elements", F.col("el"))
    l = q.join(pages(spark, sf_dir).select("doc", "elements"), "doc").select("qid", "doc", F.when(at > 0, at - 1).alias("pos"), F.size(F.filter("elements", lambda x: x == F.col("el"))).alias("times"))
    c = table(spark, sf_dir, "chunks").where("strategy = 'fixed'").select(F.col("doc").alias("d"), "chunk_id", "el_start", "el_end").distinct()
    g = l.join(c, (F.col("doc") == F.col("d")) & (F.col("pos") >= F.col("el_start")) & (F.col("pos") < F.col("el_end")), "left")
    return g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_distinct("chunk_id").alias("n_chunks"), F.sum(F.col("pos").isNull().cast("bigint")).alias("n_unlocated"), F.sum((F.col("times") > 1).cast("bigint")).alias("n_ambiguous"))


@query("""WITH RECURSIVE g AS (SELECT DISTINCT instance_id, document_id AS d FROM (SELECT instance_id, unnest(list_transform(passages, lambda p: p.document_id)) AS document_id FROM gold_instances) WHERE document_id IS NOT NULL),
near AS (SELECT DISTINCT a.instance_id AS a, b.instance_id AS b FROM g a JOIN g b USING (d)), r(root, x) AS (SELECT DISTINCT instance_id, instance_id FROM g UNION SELECT r.root, n.b FROM r JOIN near n ON n.a = r.x)
SELECT x AS instance_id, min(root) AS group_id FROM r GROUP BY x""")
def document_groups(spark, sf_dir):
    """Instances linked by shared documents, as connected components."""
    g = table(spark, sf_dir, "gold_instances").select("instance_id", F.explode("passages.document_id").alias("d")).where("d IS NOT NULL").distinct()
    # ids sort before the prefix of documents, so a component is named by its least instance
    e = g.select(F.concat(F.lit("0"), "instance_id").alias("a"), F.concat(F.lit("1"), "d").alias("b"))
    return components(e).where("node LIKE '0%'").select(F.expr("substring(node, 2)").alias("instance_id"), F.expr("substring(component, 2)").alias("group_id"))


@query(rf"""WITH {DOCS}, w AS (SELECT doc_id, publisher, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM docs WHERE text IS NOT NULL AND publisher IS NOT NULL), s AS (SELECT DISTINCT doc_id, publisher, array_to_string(list_slice(t, i, i + 9), ' ') AS sh FROM (SELECT doc_id, publisher, t, unnest(range(1, greatest(len(t) - 8, 1)::BIGINT)) AS i FROM w) WHERE len(t) >= 10),
k AS (SELECT sh FROM s GROUP BY sh HAVING count(DISTINCT publisher) > 1) SELECT doc_id, count(*) AS n_shared FROM s JOIN k USING (sh) GROUP BY doc_id""")
def quoted_runs(spark, sf_dir):
    """Runs of ten words that documents of another publisher hold too: shingles are aggregated by hash before they are joined."""
    d = documents(spark, sf_dir).where("text IS NOT NULL AND publisher IS NOT NULL").select("doc_id", "publisher", T.tokens(F.col("text")).alias("t")).where("size(t) >= 10")
    sh = F.transform(F.sequence(F.lit(1), F.size("t") - 9), lambda i: F.xxhash64(F.array_join(F.slice("t", i, 10), " ")))
    s = d.select("doc_id", "publisher", F.explode(F.array_distinct(sh)).alias("sh"))
    k = s.groupBy("sh").agg(F.min("publisher").alias("lo"), F.max("publisher").alias("hi")).where("lo <> hi").select("sh")
    return s.join(k, "sh").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shared"))


MONTHS = "January February March April May June July August September October November December".split()


@query(r"""WITH d AS (SELECT doc_id, max(text) AS t FROM documents GROUP BY doc_id), x AS (SELECT doc_id, regexp_extract(t, '(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})', 1) AS d, regexp_extract(t, '(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})', 2) AS m, regexp_extract(t, '(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})', 3) AS y FROM d)
SELECT doc_id, y || '-' || lpad(list_position(['January','February','March','April','May','June','July','August','September','October','November','December'], m)::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') AS date FROM x WHERE y <> ''""")
def first_dates(spark, sf_dir):
    """The first date written out in each document, as ISO text."""
    pat = rf"(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{4}})"
    part = lambda i: F.regexp_extract("text", pat, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2)).cast("string")
    d = documents(spark, sf_dir).withColumn("y", part(3)).where("y <> ''")
    return d.select("doc_id", F.concat_ws("-", "y", F.lpad(month, 2, "0"), F.lpad(part(1), 2, "0")).alias("date"))


@query()
def pair_classifier(spark, sf_dir):
    """A logistic head over pair features, fitted on one half of the instances by hash and scored on the other (held-out accuracy)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from quernstone.queries.pairs import FEATURES as names
    from quernstone.queries.pairs import _featured, gold

    best = _featured(spark, sf_dir).groupBy("instance_id").agg(*[F.max(n).cast("double").alias(n) for n in names])
    y = gold(spark, sf_dir).select("instance_id", (F.col("gold_conflict_type") == "conditional").cast("double").alias("label"))
    x = VectorAssembler(inputCols=names, outputCol="features").transform(best.join(y, "instance_id"))
    half = F.pmod(F.xxhash64("instance_id"), F.lit(2))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(x.where(half == 0))
    scored = model.transform(x.where(half == 1))
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
