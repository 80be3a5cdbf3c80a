"""Parents of elements, chunks that hold a sentence, reranking, clauses, scope matches and figures that nothing supports."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import matching as X
from quernstone.operators import metrics as M
from quernstone.queries._registry import family
from quernstone.queries.composition import FOLD, PAIRED, instances, related
from quernstone.queries.contexts import FIXED, RANKED, fixed, ranked
from quernstone.queries.evaluation import cells
from quernstone.queries.matching import ONUM, OTOK
from quernstone.queries.pairs import JAC
from quernstone.queries.study import QK, questions
from quernstone.queries.text import ELEMENTS, SENTENCES, WORDS, documents, elements, pages

QUERIES, ORACLES, query = family()

BUDGET = 150


@query(f"""WITH {ELEMENTS}, e AS (SELECT doc, pos, {WORDS.format('txt')} AS w, sum(CASE WHEN tag IN ('h1','h2') OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM el), s AS (SELECT *, min(pos) OVER p AS lo, max(pos) OVER p AS hi, sum(w) OVER p AS total FROM e WINDOW p AS (PARTITION BY doc, sec)),
l AS (SELECT doc, list(w ORDER BY pos) AS ws FROM e GROUP BY doc), g AS (SELECT s.*, list_max(list_filter(range(hi - lo + 1), lambda r: list_sum(list_slice(ws, greatest(lo, pos - r) + 1, least(hi, pos + r) + 1)) <= {BUDGET})) AS r FROM s JOIN l USING (doc))
SELECT doc, pos, CASE WHEN total <= {BUDGET} THEN lo WHEN r IS NULL THEN pos ELSE greatest(lo, pos - r) END AS first_pos, CASE WHEN total <= {BUDGET} THEN hi WHEN r IS NULL THEN pos ELSE least(hi, pos + r) END AS last_pos FROM g""")
def element_parents(spark, sf_dir):
    """What is shown for an element: its whole section if that fits the budget of words, else the widest stretch around it inside the
    section, as many elements on both sides; at least itself."""
    e = elements(spark, sf_dir).select("doc", "pos", T.word_count(F.col("txt")).alias("w"), (F.col("tag").isin(*T.TOP_HEADINGS) | (F.col("pos") == 0)).cast("bigint").alias("o"))
    e = e.withColumn("sec", F.sum("o").over(Window.partitionBy("doc").orderBy("pos")))
    p = Window.partitionBy("doc", "sec")
    s = e.withColumn("lo", F.min("pos").over(p)).withColumn("hi", F.max("pos").over(p)).withColumn("total", F.sum("w").over(p))
    ws = pages(spark, sf_dir).select("doc", F.transform("elements", lambda x: T.word_count(T.text_of(x))).alias("ws"))
    j = s.join(ws, "doc")
    words = lambda r: F.aggregate(F.slice("ws", (F.greatest("lo", F.col("pos") - r) + 1).cast("int"), (F.least("hi", F.col("pos") + r) - F.greatest("lo", F.col("pos") - r) + 1).cast("int")), F.lit(0).cast("bigint"), lambda a, w: a + w)
    r = F.array_max(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("hi") - F.col("lo")), lambda i: words(i) <= BUDGET))
    j = j.withColumn("r", F.coalesce(r, F.lit(0)))
    whole = F.col("total") <= BUDGET
    return j.select("doc", "pos", F.when(whole, F.col("lo")).otherwise(F.greatest("lo", F.col("pos") - F.col("r"))).alias("first_pos"), F.when(whole, F.col("hi")).otherwise(F.least("hi", F.col("pos") + F.col("r"))).alias("last_pos"))


BODY = f"{ELEMENTS}, {FIXED}, bd AS (SELECT fx.chunk_id, fx.doc, fx.idx, string_agg(txt, ' ' ORDER BY pos) AS body FROM fx JOIN el ON el.doc = fx.doc AND pos >= el_start AND pos < el_end GROUP BY ALL)"


def bodies(spark, sf_dir):
    """(chunk_id, doc, idx, body): texts of the fixed chunks."""
    p = pages(spark, sf_dir).select("doc", F.transform("elements", T.text_of).alias("t"))
    c = fixed(spark, sf_dir).where("el_start < el_end").join(p, "doc").where("el_start < size(t)")
    return c.select("chunk_id", "doc", "idx", F.array_join(F.slice("t", F.col("el_start") + 1, F.col("el_end") - F.col("el_start")), " ").alias("body"))


@query(f"""WITH {BODY}, {QK}, ev AS (SELECT DISTINCT qid, doc, rtrim(regexp_replace({FOLD.format("regexp_replace(regexp_replace(e, '^<\\w+>', ''), '</\\w+>$', '')")}, '\\.$', '')) AS s FROM (SELECT qid, doc, unnest(ev) AS e FROM qk)),
h AS (SELECT qid, s, bd.chunk_id, bd.idx FROM ev JOIN bd ON bd.doc = ev.doc WHERE s <> '' AND contains({FOLD.format('body')}, s)) SELECT qid, md5(s) AS sentence_md5, arg_min(chunk_id, (idx, chunk_id)) AS chunk_id FROM h GROUP BY qid, s""")
def chunk_of_sentence(spark, sf_dir):
    """The first chunk of a question's page that holds an evidence sentence, white space, case and the last stop aside."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, f"[{T.SPACE}]+", " ")))
    e = questions(spark, sf_dir).select("qid", "doc", F.explode("evidences").alias("e"))
    bare = F.regexp_replace(F.regexp_replace("e", r"^<\w+>", ""), r"</\w+>$", "")
    s = e.select("qid", "doc", F.rtrim(F.regexp_replace(fold(bare), r"\.$", "")).alias("s")).where("s <> ''").distinct()
    h = s.join(bodies(spark, sf_dir).withColumn("b", fold(F.col("body"))), "doc").where(F.contains("b", F.col("s")))
    return h.groupBy("qid", "s").agg(F.min(F.struct("idx", "chunk_id"))["chunk_id"].alias("chunk_id")).select("qid", F.md5("s").alias("sentence_md5"), "chunk_id")


@query(f"""WITH {BODY}, {RANKED}, qt AS (SELECT qid, {OTOK("coalesce(any_value(question), '')")} AS tq FROM questions WHERE qid IS NOT NULL GROUP BY qid), s AS (SELECT rn.qid, rn.ranker, rn.chunk_id, rn.rank, round(len(list_intersect(tq, {OTOK('body')})) / nullif(len(tq), 0), 9) AS score FROM rn JOIN bd USING (chunk_id) JOIN qt USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY coalesce(score, 0) DESC, rank) AS place FROM s) SELECT qid, ranker, chunk_id, round(coalesce(score, 0), 6) AS score, place FROM r WHERE place <= 3""")
def reranked_top3(spark, sf_dir):
    """Ranked chunks ordered anew by the share of the question's words they hold, of equal ones by their old rank; the best three."""
    from quernstone.sources.tables import table

    q = table(spark, sf_dir, "questions").where("qid IS NOT NULL").groupBy("qid").agg(F.first("question").alias("question")).select("qid", X.outcome_tokens(F.col("question")).alias("tq"))
    s = ranked(spark, sf_dir).join(bodies(spark, sf_dir).select("chunk_id", X.outcome_tokens(F.col("body")).alias("tb")), "chunk_id").join(q, "qid")
    s = s.withColumn("score", F.round(T.containment(F.col("tq"), F.col("tb")), 9))
    r = s.withColumn("place", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy(F.desc("score"), "rank")).cast("bigint")).where("place <= 3")
    return r.select("qid", "ranker", "chunk_id", F.round("score", 6).alias("score"), "place")


@query(f"""WITH {PAIRED}, ds AS (SELECT instance_id, b.branch_id AS bid, coalesce(b.applicability.descriptor, '') AS d FROM (SELECT instance_id, unnest(any_value(gold_branches)) AS b FROM gold_instances WHERE instance_id IS NOT NULL GROUP BY instance_id)), t AS (SELECT rr.*, {OTOK('x.d')} AS ta, {OTOK('y.d')} AS tb FROM rr JOIN ds x ON x.instance_id = rr.instance_id AND x.bid = rr.a JOIN ds y ON y.instance_id = rr.instance_id AND y.bid = rr.b)
SELECT instance_id, a, b, CASE WHEN da OR db THEN da = db WHEN relation IN ('equal', 'subset') THEN true ELSE {JAC('ta', 'tb')} >= CASE WHEN relation = 'unknown' THEN 0.35 ELSE 0.8 END END AS same_scope FROM t""")
def scope_matches(spark, sf_dir):
    """Whether a predicted scope is that of gold: equal or narrower by its attributes, else by much the same descriptor."""
    d = instances(spark, sf_dir).select("instance_id", F.explode("bs").alias("x")).select("instance_id", F.col("x.branch_id").alias("k"), F.coalesce("x.applicability.descriptor", F.lit("")).alias("d"))
    own = lambda c: d.select("instance_id", F.col("k").alias(c), F.col("d").alias(f"d_{c}"))
    r = related(spark, sf_dir).join(own("a"), ["instance_id", "a"]).join(own("b"), ["instance_id", "b"])
    alike = X.similarity(F.col("d_a"), F.col("d_b")) >= F.when(F.col("relation") == "unknown", 0.35).otherwise(0.8)
    return r.select("instance_id", "a", "b", F.when(F.col("da") | F.col("db"), F.col("da") == F.col("db")).when(F.col("relation").isin("equal", "subset"), True).otherwise(alike).alias("same_scope"))


@query(f"""WITH c AS (SELECT cell_id, system, coalesce(any_value(answers)[1].answer, '') AS a, array_to_string(coalesce(any_value(evidence), []), ' ') AS e FROM result_cells GROUP BY cell_id, system), n AS (SELECT system, {ONUM('a')} AS na, {ONUM('e')} AS ne FROM c)
SELECT system, count(*) AS n, count(*) FILTER (len(na) > 0) AS n_with_figures, count(*) FILTER (len(list_filter(na, lambda x: NOT list_contains(ne, x))) > 0) AS n_unsupported, sum(len(list_filter(na, lambda x: NOT list_contains(ne, x))))::BIGINT AS n_figures_unsupported FROM n GROUP BY system""")
def unsupported_figures(spark, sf_dir):
    """Figures of answers that the evidence they cite does not hold."""
    a = X.numbers(F.get("answers.answer", F.lit(0)))
    e = X.numbers(F.array_join(F.coalesce("evidence", F.array()), " "))
    n = cells(spark, sf_dir).select("system", a.alias("na"), F.array_except(a, e).alias("x"))
    return n.groupBy("system").agg(F.count(F.lit(1)).alias("n"), M.count_if(F.size("na") > 0).alias("n_with_figures"), M.count_if(F.size("x") > 0).alias("n_unsupported"), F.sum(F.size("x")).cast("bigint").alias("n_figures_unsupported"))


@query(rf"""WITH {SENTENCES}, f AS (SELECT doc_id, arg_min(s, pos) AS s FROM sents GROUP BY doc_id), t AS (SELECT doc_id, rtrim(regexp_replace(s, '\.$', '')) AS s FROM f), c AS (SELECT doc_id, s, CASE WHEN regexp_matches(s, '^[A-Z]{{2}}') THEN s ELSE lower(substr(s, 1, 1)) || substr(s, 2) END AS clause FROM t)
SELECT doc_id, md5(clause) AS clause_md5, regexp_matches(s, '(?i)\b(must|may|can|cannot|is|are|will|pays?|keeps?|ends?)\b') AND length(s) >= 12 AS usable FROM c""")
def opening_clauses(spark, sf_dir):
    """The first sentence of each document as a clause, its first letter small unless it is an acronym's, and whether it is a statement."""
    s = F.rtrim(F.regexp_replace(F.get(T.sentences(F.col("text")), F.lit(0)), r"\.$", ""))
    d = documents(spark, sf_dir).select("doc_id", s.alias("s")).where("s IS NOT NULL")
    clause = F.when(F.col("s").rlike("^[A-Z]{2}"), F.col("s")).otherwise(F.concat(F.lower(F.substring("s", 1, 1)), F.expr("substring(s, 2)")))
    return d.select("doc_id", F.md5(clause).alias("clause_md5"), (F.col("s").rlike(r"(?i)\b(must|may|can|cannot|is|are|will|pays?|keeps?|ends?)\b") & (F.length("s") >= 12)).alias("usable"))
