"""Contexts shown to a reader: gold and its deletions, padding, completion, budgets, units, numbering of evidence."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.queries._registry import family
from quernstone.queries.evaluation import cells
from quernstone.queries.study import LOCATED, QK, RANKS, SETS, gold_sets, located, questions, stored_ranks
from quernstone.queries.text import ELEMENTS, WORDS, elements, pages
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()

FIXED = "fx AS (SELECT DISTINCT chunk_id, doc, idx, el_start, el_end FROM chunks WHERE strategy = 'fixed')"


def fixed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("strategy = 'fixed'").select("chunk_id", "doc", "idx", "el_start", "el_end").distinct()


def ranked(spark, sf_dir) -> DataFrame:
    """(qid, ranker, rank, chunk_id) of the stored rankings, each chunk at its best rank."""
    r = stored_ranks(spark, sf_dir).select("qid", "ranker", F.posexplode("ch").alias("p", "chunk_id"))
    return r.groupBy("qid", "ranker", "chunk_id").agg((F.min("p") + 1).cast("bigint").alias("rank"))


RANKED = f"{RANKS}, rn AS (SELECT qid, ranker, chunk_id, min(p) AS rank FROM (SELECT qid, ranker, unnest(ch) AS chunk_id, unnest(range(1, len(ch) + 1)) AS p FROM ranked) GROUP BY ALL)"


@query(f"WITH {LOCATED} SELECT qid, string_agg(chunk_id, ' ' ORDER BY idx) AS chunks FROM (SELECT DISTINCT qid, chunk_id, idx FROM gl) GROUP BY qid")
def gold_contexts(spark, sf_dir):
    """The chunks that hold a question's gold, in the order of the page."""
    g = located(spark, sf_dir).select("qid", "idx", "chunk_id").distinct()
    return g.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_id"))), lambda x: x["chunk_id"]), " ").alias("chunks"))


@query(f"""WITH {LOCATED}, ch AS (SELECT DISTINCT qid, doc, chunk_id, el_start, el_end FROM gl JOIN fc USING (doc, chunk_id)), e AS (SELECT ch.qid, pe.pos, pe.raw FROM ch JOIN pe ON pe.doc = ch.doc AND pe.pos >= el_start AND pe.pos < el_end)
SELECT e.qid, count(*) AS n_elements, count(*) FILTER (NOT list_contains(co, raw)) AS n_without, md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT list_contains(co, raw)), '')) AS without_md5 FROM e JOIN qk USING (qid) GROUP BY e.qid""")
def gold_without_conditions(spark, sf_dir):
    """Gold chunks with the elements that are conditions deleted."""
    g = located(spark, sf_dir).select("qid", "doc", "chunk_id").distinct().join(fixed(spark, sf_dir).drop("idx"), ["doc", "chunk_id"])
    e = g.join(pages(spark, sf_dir).select("doc", "elements"), "doc")
    part = F.transform(F.sequence("el_start", F.col("el_end") - 1), lambda i: F.struct(i.alias("pos"), F.get("elements", i).alias("raw")))
    e = e.where("el_start < el_end").select("qid", F.explode(part).alias("x")).select("qid", "x.*").where("raw IS NOT NULL").join(questions(spark, sf_dir).select("qid", "co"), "qid")
    keep = ~F.array_contains("co", F.col("raw"))
    left = F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "raw")))), lambda x: x["raw"])
    return e.groupBy("qid").agg(F.count(F.lit(1)).alias("n_elements"), F.sum(keep.cast("bigint")).alias("n_without"), F.md5(F.array_join(left, "\n")).alias("without_md5"))


@query(f"WITH {LOCATED}, {SETS} SELECT qid, array_to_string(list_sort(list_filter(every, lambda x: NOT (list_contains(c, x) AND NOT list_contains(a, x)))), ' ') AS chunks, len(list_filter(c, lambda x: NOT list_contains(a, x))) AS n_removed FROM sets")
def gold_without_condition_chunks(spark, sf_dir):
    """Gold chunks but those that hold conditions only."""
    s = gold_sets(spark, sf_dir)
    only = F.array_except("c", "a")
    return s.select("qid", F.array_join(F.array_sort(F.array_except("every", only)), " ").alias("chunks"), F.size(only).cast("bigint").alias("n_removed"))


@query(f"""WITH {LOCATED}, {RANKED}, g AS (SELECT DISTINCT qid, chunk_id FROM gl), u AS (SELECT g.qid, r.ranker, g.chunk_id, rn.rank, 0 AS tier FROM g JOIN (SELECT DISTINCT qid, ranker FROM rn) r USING (qid) LEFT JOIN rn USING (qid, ranker, chunk_id)
 UNION ALL SELECT rn.qid, rn.ranker, rn.chunk_id, rn.rank, 1 FROM rn JOIN (SELECT DISTINCT qid FROM g) k USING (qid) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.qid = rn.qid AND g.chunk_id = rn.chunk_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY tier, coalesce(rank, 1000000), chunk_id) AS place FROM u) SELECT qid, ranker, string_agg(chunk_id, ' ' ORDER BY coalesce(rank, 1000000), chunk_id) AS chunks FROM p WHERE tier = 0 OR place <= 4 GROUP BY qid, ranker""")
def padded_gold(spark, sf_dir):
    """All gold and, up to four chunks, the best ranked others, in the order of their ranks; what was not ranked stands last."""
    r, g = ranked(spark, sf_dir), located(spark, sf_dir).select("qid", "chunk_id").distinct()
    own = g.join(r.select("qid", "ranker").distinct(), "qid").join(r, ["qid", "ranker", "chunk_id"], "left").withColumn("tier", F.lit(0))
    other = r.join(g, ["qid", "chunk_id"], "left_anti").join(g.select("qid").distinct(), "qid", "left_semi").withColumn("tier", F.lit(1))
    u = own.select("qid", "ranker", "chunk_id", "rank", "tier").unionByName(other).withColumn("at", F.coalesce("rank", F.lit(1_000_000)))
    p = u.withColumn("place", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("tier", "at", "chunk_id"))).where("tier = 0 OR place <= 4")
    return p.groupBy("qid", "ranker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]), " ").alias("chunks"))


CANDIDATES = f"""{LOCATED}, {SETS}, {RANKED}, rd AS (SELECT rn.*, fx.doc, fx.idx FROM rn JOIN (SELECT DISTINCT chunk_id, doc, idx FROM chunks WHERE strategy = 'fixed') fx USING (chunk_id)),
pg AS (SELECT qid, ranker, doc, min(rank) AS best FROM rd WHERE rank <= 5 GROUP BY ALL), p2 AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY best, doc) AS n FROM pg),
an AS (SELECT p2.qid, p2.ranker, p2.doc, rd.chunk_id AS anchor FROM p2 JOIN rd ON rd.qid = p2.qid AND rd.ranker = p2.ranker AND rd.doc = p2.doc AND rd.rank = p2.best WHERE n <= 2),
cd AS (SELECT an.qid, an.ranker, an.anchor, f.chunk_id, f.idx FROM an JOIN (SELECT DISTINCT chunk_id, doc, idx FROM chunks WHERE strategy = 'fixed') f ON f.doc = an.doc WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.qid = an.qid AND rn.ranker = an.ranker AND rn.chunk_id = f.chunk_id AND rn.rank <= 5))"""


def candidates(spark, sf_dir) -> DataFrame:
    """(qid, ranker, anchor, chunk_id, idx): chunks of the first two pages among the top five that were not retrieved, with the best ranked
    chunk of their page."""
    f = fixed(spark, sf_dir).select("chunk_id", "doc", "idx")
    top = ranked(spark, sf_dir).where("rank <= 5")
    per = top.join(f.drop("idx"), "chunk_id").groupBy("qid", "ranker", "doc").agg(F.min(F.struct("rank", "chunk_id")).alias("b"))
    per = per.withColumn("n", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("b.rank", "doc"))).where("n <= 2").select("qid", "ranker", "doc", F.col("b.chunk_id").alias("anchor"))
    return per.join(f, "doc").join(top.select("qid", "ranker", "chunk_id"), ["qid", "ranker", "chunk_id"], "left_anti").select("qid", "ranker", "anchor", "chunk_id", "idx")


@query(f"WITH {CANDIDATES} SELECT cd.qid, ranker, anchor, chunk_id, list_contains(s.c, chunk_id) AS holds_condition FROM cd JOIN sets s USING (qid)")
def completion_candidates(spark, sf_dir):
    """Chunks of the retrieved pages that were not shown, and whether they hold a condition."""
    return candidates(spark, sf_dir).join(gold_sets(spark, sf_dir).select("qid", "c"), "qid").select("qid", "ranker", "anchor", "chunk_id", F.array_contains("c", F.col("chunk_id")).alias("holds_condition"))


@query(f"""WITH {CANDIDATES}, l AS (SELECT cd.*, list_contains(s.c, chunk_id) AS y, row_number() OVER (PARTITION BY qid, ranker, list_contains(s.c, chunk_id) ORDER BY md5(qid || chunk_id), chunk_id) AS r FROM cd JOIN sets s USING (qid))
SELECT qid, ranker, anchor, chunk_id, y AS label FROM l WHERE y OR r <= 6""")
def completion_training_pairs(spark, sf_dir):
    """All positive candidates and six negatives of each question and ranker, in the order of a hash."""
    l = candidates(spark, sf_dir).join(gold_sets(spark, sf_dir).select("qid", "c"), "qid").withColumn("label", F.array_contains("c", F.col("chunk_id")))
    w = Window.partitionBy("qid", "ranker", "label").orderBy(F.md5(F.concat("qid", "chunk_id")), "chunk_id")
    return l.withColumn("r", F.row_number().over(w)).where("label OR r <= 6").select("qid", "ranker", "anchor", "chunk_id", "label")


OVER = lambda a, b: f"len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)"
TOKS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH {CANDIDATES}, el AS (SELECT doc, unnest(elements) AS raw, unnest(range(len(elements))) AS pos FROM pages), ct AS (SELECT f.chunk_id, {TOKS.format("string_agg(raw, ' ' ORDER BY pos)")} AS t FROM (SELECT DISTINCT chunk_id, doc, el_start, el_end FROM chunks WHERE strategy = 'fixed') f JOIN el ON el.doc = f.doc AND pos >= el_start AND pos < el_end GROUP BY f.chunk_id),
sc AS (SELECT cd.qid, cd.ranker, cd.chunk_id, round(coalesce({OVER('x.t', 'y.t')}, 0), 9) AS s FROM cd JOIN ct x ON x.chunk_id = cd.anchor JOIN ct y ON y.chunk_id = cd.chunk_id),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY s DESC, chunk_id) AS r FROM sc WHERE s >= 0.15), u AS (SELECT qid, ranker, chunk_id, rank AS o FROM rn WHERE rank <= 5 UNION ALL SELECT qid, ranker, chunk_id, 100 + r FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY o) AS place FROM u) SELECT qid, ranker, string_agg(chunk_id, ' ' ORDER BY o) AS chunks FROM p WHERE place <= 8 GROUP BY qid, ranker""")
def completed_contexts(spark, sf_dir):
    """The top five and the best scored candidates of their pages, up to eight; the score is the overlap with the anchor's words."""
    p = pages(spark, sf_dir).select("doc", "elements")
    body = F.array_join(F.slice("elements", F.col("el_start") + 1, F.greatest(F.col("el_end") - F.col("el_start"), F.lit(0))), " ")
    ct = fixed(spark, sf_dir).join(p, "doc").where("el_start < el_end AND el_start < size(elements)").select("chunk_id", F.array_distinct(T.tokens(body)).alias("t"))
    c = candidates(spark, sf_dir).join(ct, "chunk_id").join(ct.select(F.col("chunk_id").alias("anchor"), F.col("t").alias("at")), "anchor")
    c = c.withColumn("s", F.round(T.jaccard(F.col("at"), F.col("t")), 9)).where("s >= 0.15")
    b = c.select("qid", "ranker", "chunk_id", (100 + F.row_number().over(Window.partitionBy("qid", "ranker").orderBy(F.desc("s"), "chunk_id"))).cast("bigint").alias("o"))
    u = ranked(spark, sf_dir).where("rank <= 5").select("qid", "ranker", "chunk_id", F.col("rank").alias("o")).unionByName(b)
    u = u.withColumn("place", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("o"))).where("place <= 8")
    return u.groupBy("qid", "ranker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "chunk_id"))), lambda x: x["chunk_id"]), " ").alias("chunks"))


@query(f"""WITH {CANDIDATES}, b AS (SELECT cd.qid, cd.ranker, cd.chunk_id, row_number() OVER (PARTITION BY cd.qid, cd.ranker ORDER BY cd.chunk_id) AS r FROM cd JOIN sets s USING (qid) WHERE list_contains(s.c, chunk_id)),
u AS (SELECT qid, ranker, chunk_id, rank AS o FROM rn WHERE rank <= 5 UNION ALL SELECT qid, ranker, chunk_id, 100 + r FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY o) AS place FROM u)
SELECT qid, ranker, count(*) AS n_chunks, count(*) FILTER (o > 100) AS n_added FROM p WHERE place <= 8 GROUP BY qid, ranker""")
def oracle_completion(spark, sf_dir):
    """The top five and the candidates that do hold a condition, up to eight: what completion could reach."""
    c = candidates(spark, sf_dir).join(gold_sets(spark, sf_dir).select("qid", "c"), "qid").where(F.array_contains("c", F.col("chunk_id")))
    b = c.select("qid", "ranker", "chunk_id", (100 + F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("chunk_id"))).cast("bigint").alias("o"))
    u = ranked(spark, sf_dir).where("rank <= 5").select("qid", "ranker", "chunk_id", F.col("rank").alias("o")).unionByName(b)
    u = u.withColumn("place", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("o"))).where("place <= 8")
    return u.groupBy("qid", "ranker").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum((F.col("o") > 100).cast("bigint")).alias("n_added"))


@query(f"""WITH {ELEMENTS}, {RANKED}, {FIXED}, w AS (SELECT fx.chunk_id, sum({WORDS.format('txt')}) AS n FROM fx JOIN el ON el.doc = fx.doc AND pos >= el_start AND pos < el_end GROUP BY fx.chunk_id) SELECT qid, ranker, sum(n)::BIGINT AS budget FROM rn JOIN w USING (chunk_id) WHERE rank <= 8 GROUP BY qid, ranker""")
def word_budgets(spark, sf_dir):
    """Words of the first eight chunks of each ranking: the budget that other designs may fill."""
    p = pages(spark, sf_dir).select("doc", F.transform("elements", lambda e: T.word_count(T.text_of(e))).alias("n"))
    part = F.slice("n", F.col("el_start") + 1, F.greatest(F.col("el_end") - F.col("el_start"), F.lit(0)))
    w = fixed(spark, sf_dir).join(p, "doc").where("el_start < el_end AND el_start < size(n)").select("chunk_id", F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"))
    return ranked(spark, sf_dir).where("rank <= 8").join(w, "chunk_id").groupBy("qid", "ranker").agg(F.sum("n").alias("budget"))


@query(f"""WITH {ELEMENTS}, h AS (SELECT doc, pos, title, txt, tag, last_value(CASE WHEN tag IN ('h1','h2','h3','h4') THEN txt END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM el)
SELECT doc, pos, md5(concat_ws(chr(10), concat_ws(' - ', title, heading), txt)) AS unit_md5 FROM h""")
def element_units(spark, sf_dir):
    """The index text of each element: title and nearest heading at or above it, then the element."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h = elements(spark, sf_dir).withColumn("heading", F.last(F.when(F.col("tag").isin(*T.HEADINGS), F.col("txt")), True).over(w))
    return h.select("doc", "pos", F.md5(F.concat_ws("\n", F.concat_ws(" - ", "title", "heading"), "txt")).alias("unit_md5"))


EL = f"""{ELEMENTS}, {QK}, {RANKED}, {FIXED}, sh AS (SELECT rn.qid, rn.ranker, rn.rank, fx.doc, pos, raw, txt FROM rn JOIN fx USING (chunk_id) JOIN el ON el.doc = fx.doc AND pos >= el_start AND pos < el_end)"""


def shown(spark, sf_dir) -> DataFrame:
    """(qid, ranker, rank, doc, pos, raw): elements of the ranked chunks."""
    p = pages(spark, sf_dir).select("doc", "elements")
    part = F.transform(F.sequence("el_start", F.col("el_end") - 1), lambda i: F.struct(i.cast("bigint").alias("pos"), F.get("elements", i).alias("raw")))
    f = fixed(spark, sf_dir).where("el_start < el_end").join(p, "doc").select("chunk_id", "doc", F.explode(part).alias("x")).select("chunk_id", "doc", "x.*").where("raw IS NOT NULL")
    return ranked(spark, sf_dir).join(f, "chunk_id").select("qid", "ranker", "rank", "doc", "pos", "raw")


@query(f"""WITH {EL}, s AS (SELECT qid, ranker, list_distinct(list(raw)) AS e, sum({WORDS.format('txt')}) AS w FROM sh WHERE rank <= 8 GROUP BY qid, ranker), x AS (SELECT ranker, e, w, co, ae, kind FROM s JOIN qk USING (qid) WHERE kind <> 'unanswerable')
SELECT ranker, count(*) AS n, round(sum(len(list_intersect(co, e))) / nullif(sum(len(co)), 0), 6) AS condition_recall, round(sum(len(list_intersect(ae, e))) / nullif(sum(len(ae)), 0), 6) AS answer_recall,
round(avg((len(list_intersect(co, e)) = len(co) AND len(list_intersect(ae, e)) = len(ae))::INT), 6) AS complete, round(avg(w), 6) AS words FROM x GROUP BY ranker""")
def element_recall(spark, sf_dir):
    """Of the gold elements, the share that the first eight chunks show, pooled; questions whose gold is complete; words shown."""
    s = shown(spark, sf_dir).where("rank <= 8").groupBy("qid", "ranker").agg(F.collect_set("raw").alias("e"), F.sum(T.word_count(T.text_of(F.col("raw")))).alias("w"))
    x = s.join(questions(spark, sf_dir).where("kind <> 'unanswerable'").select("qid", "co", "ae"), "qid")
    has = lambda c: F.size(F.array_intersect(c, "e"))
    pooled = lambda c: F.round(F.try_divide(F.sum(has(c)), F.sum(F.size(c))), 6)
    whole = (has("co") == F.size("co")) & (has("ae") == F.size("ae"))
    return x.groupBy("ranker").agg(F.count(F.lit(1)).alias("n"), pooled("co").alias("condition_recall"), pooled("ae").alias("answer_recall"), F.round(F.avg(whole.cast("int")), 6).alias("complete"), F.round(F.avg("w"), 6).alias("words"))


@query(f"WITH {EL}, n AS (SELECT qid, ranker, row_number() OVER (PARTITION BY qid, ranker ORDER BY rank, pos) AS line, raw, co FROM sh JOIN qk USING (qid) WHERE rank <= 3 AND NOT list_contains(co, raw)) SELECT qid, ranker, count(*) AS n_lines, md5(string_agg('[' || line || '] ' || raw, chr(10) ORDER BY line)) AS evidence_md5 FROM n GROUP BY qid, ranker")
def numbered_evidence(spark, sf_dir):
    """Elements of the first three chunks numbered through, those that are conditions dropped."""
    s = shown(spark, sf_dir).where("rank <= 3").join(questions(spark, sf_dir).select("qid", "co"), "qid").where(~F.array_contains("co", F.col("raw")))
    n = s.withColumn("line", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("rank", "pos")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: F.concat(F.lit("["), x["line"].cast("string"), F.lit("] "), x["raw"]))
    return n.groupBy("qid", "ranker").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("evidence_md5"))


@query(r"""WITH c AS (SELECT cell_id, any_value(text) AS t, any_value(n_lines) AS n FROM result_cells WHERE text IS NOT NULL GROUP BY cell_id), l AS (SELECT cell_id, n, list_transform(regexp_extract_all(replace(replace(t, chr(10), ' '), ' ', ''), '"evidence":\[[0-9,]*\]'), lambda x: list_transform(regexp_extract_all(x, '[0-9]+'), lambda y: y::BIGINT)) AS v FROM c),
f AS (SELECT cell_id, n, flatten(v) AS v FROM l) SELECT cell_id, len(v)::BIGINT AS n_cited, len(list_distinct(list_filter(v, lambda y: y BETWEEN 1 AND n)))::BIGINT AS n_lines_cited, len(list_filter(v, lambda y: NOT y BETWEEN 1 AND n))::BIGINT AS n_bad FROM f""")
def cited_lines(spark, sf_dir):
    """Line numbers that replies cite: distinct ones that exist, and those that do not."""
    c = cells(spark, sf_dir).where("text IS NOT NULL").select("cell_id", F.col("n_lines").alias("n"), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit("")).alias("t"))
    lists = F.regexp_extract_all("t", F.lit(r'("evidence":\[[0-9,]*\])'), F.lit(1))
    v = F.transform(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)))), lambda y: y.cast("bigint"))
    c = c.withColumn("v", v)
    ok = lambda y: (y >= 1) & (y <= F.col("n"))
    return c.select("cell_id", F.size("v").cast("bigint").alias("n_cited"), F.size(F.array_distinct(F.filter("v", ok))).cast("bigint").alias("n_lines_cited"), F.size(F.filter("v", lambda y: ~ok(y))).cast("bigint").alias("n_bad"))


@query(f"""WITH {RANKED}, {FIXED}, d AS (SELECT rn.*, doc FROM rn JOIN fx USING (chunk_id)), b AS (SELECT qid, ranker, doc, min(rank) AS best FROM d GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY qid, ranker ORDER BY best, doc) AS n FROM b)
SELECT d.qid, d.ranker, d.chunk_id, row_number() OVER (PARTITION BY d.qid, d.ranker ORDER BY d.rank) AS rank FROM d JOIN p ON p.qid = d.qid AND p.ranker = d.ranker AND p.doc = d.doc WHERE n <= 2""")
def two_page_rankings(spark, sf_dir):
    """Rankings kept to the two pages that come first in them, ranked anew."""
    d = ranked(spark, sf_dir).join(fixed(spark, sf_dir).select("chunk_id", "doc"), "chunk_id")
    b = d.groupBy("qid", "ranker", "doc").agg(F.min("rank").alias("best"))
    b = b.withColumn("n", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("best", "doc"))).where("n <= 2").select("qid", "ranker", "doc")
    return d.join(b, ["qid", "ranker", "doc"], "left_semi").select("qid", "ranker", "chunk_id", F.row_number().over(Window.partitionBy("qid", "ranker").orderBy("rank")).cast("bigint").alias("rank"))


@query("""WITH r AS (SELECT doc, row_number() OVER (ORDER BY md5('tune' || doc::VARCHAR), doc) AS r FROM (SELECT DISTINCT doc FROM questions WHERE doc IS NOT NULL)),
k AS (SELECT qid, any_value(doc) AS doc FROM questions WHERE qid IS NOT NULL AND doc IS NOT NULL GROUP BY qid) SELECT qid, CASE WHEN r <= 40 THEN 'tuning' ELSE 'evaluation' END AS part, ('0x' || substr(md5('tune' || doc::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM k JOIN r USING (doc)""")
def evaluation_split(spark, sf_dir):
    """The forty pages that come first by a hash are for tuning, all others for evaluation; five folds of pages by that hash."""
    h = lambda c: F.md5(F.concat(F.lit("tune"), F.col(c).cast("string")))
    tuning = table(spark, sf_dir, "questions").where("doc IS NOT NULL").select("doc").distinct().orderBy(h("doc"), "doc").limit(40).withColumn("t", F.lit(True))
    k = questions(spark, sf_dir).where("doc IS NOT NULL").select("qid", "doc").join(tuning, "doc", "left")
    return k.select("qid", F.when(F.col("t"), "tuning").otherwise("evaluation").alias("part"), (F.conv(F.substring(h("doc"), 1, 8), 16, 10).cast("bigint") % 5).alias("fold"))
