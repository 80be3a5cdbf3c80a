"""Text structuring over pages, chunks and documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.html import html_text
from quernstone.operators.chunking import packed, packed_sentences
from quernstone.queries._registry import family
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()

PAGES = "pages AS (SELECT doc, arg_max(elements, fetched_at) AS elements, max(url) AS url, arg_max(title, fetched_at) AS title FROM guide_docs GROUP BY doc)"
SPACE = T.SPACE.replace("{", "{{").replace("}", "}}")  # for a format string
STRIP = rf"regexp_replace({{}}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
INNER = r"CASE WHEN regexp_matches(s, '(?s)^<\w+>.*</\w+>$') THEN regexp_replace(regexp_replace(s, '^<\w+>', ''), '</\w+>$', '') ELSE s END"
ELEMENTS = PAGES + rf""", el AS (SELECT doc, url, title, pos::BIGINT AS pos, raw,
 CASE WHEN regexp_matches(s, '(?s)^<\w+>.*</\w+>$') THEN lower(regexp_extract(s, '^<(\w+)>', 1)) ELSE 'p' END AS tag,
 {STRIP.format(INNER)} AS txt
 FROM (SELECT doc, url, title, raw, pos, {STRIP.format('raw')} AS s FROM (SELECT doc, url, title, unnest(elements) AS raw, unnest(range(len(elements))) AS pos FROM pages)))"""
WORDS = rf"len(regexp_extract_all({{}}, '[^{SPACE}]+'))::BIGINT"
DOCS = "docs AS (SELECT doc_id, max(text) AS text, max(source) AS source, max(publisher) AS publisher, max(source_type) AS source_type, max(url) AS url, max(lang) AS lang FROM documents GROUP BY doc_id)"
SENTENCES = DOCS + r""", lines AS (SELECT doc_id, source, li, trim(regexp_replace(l, '[ \t\r\f\x0B]+', ' ', 'g')) AS l FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS li FROM docs)),
sents AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY doc_id ORDER BY li, si) - 1 AS pos FROM (SELECT doc_id, source, li, unnest(ss) AS s, unnest(range(len(ss))) AS si FROM
 (SELECT doc_id, source, li, string_split(regexp_replace(l, '([.!?]) +([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM lines WHERE l <> '')))"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: what was fetched last."""
    g = table(spark, sf_dir, "guide_docs")
    last = F.struct("fetched_at", "elements", "title")
    return g.groupBy("doc").agg(F.max("url").alias("url"), F.max_by(last, "fetched_at").alias("l")).select("doc", "url", "l.title", "l.elements")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, url, title, pos, raw, tag, txt): a row for each element of a page."""
    e = pages(spark, sf_dir).select("doc", "url", "title", F.posexplode("elements").alias("pos", "raw"))
    return e.select("doc", "url", "title", F.col("pos").cast("bigint").alias("pos"), "raw", T.tag_of(F.col("raw")).alias("tag"), T.text_of(F.col("raw")).alias("txt"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document."""
    cols = ("text", "source", "publisher", "source_type", "url", "lang")
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in cols])


@query(f"WITH {ELEMENTS} SELECT tag, count(*) AS n_elements, count(DISTINCT doc) AS n_pages, sum({WORDS.format('txt')})::BIGINT AS n_words FROM el GROUP BY tag")
def page_elements(spark, sf_dir):
    """Elements parsed into tag and text: counts and words per tag."""
    return elements(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n_elements"), F.count_distinct("doc").alias("n_pages"), F.sum(T.word_count(F.col("txt"))).alias("n_words"))


@query(f"WITH {ELEMENTS} SELECT doc, pos, last_value(CASE WHEN tag IN ('h1','h2','h3','h4') THEN txt END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM el")
def element_headings(spark, sf_dir):
    """The nearest heading above each element."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return elements(spark, sf_dir).select("doc", "pos", F.last(F.when(F.col("tag").isin(*T.HEADINGS), F.col("txt")), True).over(w).alias("heading"))


@query(f"""WITH {ELEMENTS}, s AS (SELECT *, sum(CASE WHEN tag IN ('h1','h2') OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM el)
SELECT doc, sec::BIGINT AS section, min(pos) AS first_pos, max(pos) AS last_pos, sum({WORDS.format('txt')})::BIGINT AS n_words FROM s GROUP BY doc, sec""")
def page_sections(spark, sf_dir):
    """Sections of a page, each from a top heading to the next."""
    w = Window.partitionBy("doc").orderBy("pos")
    opens = (F.col("tag").isin(*T.TOP_HEADINGS) | (F.col("pos") == 0)).cast("bigint")
    s = elements(spark, sf_dir).withColumn("section", F.sum(opens).over(w))
    return s.groupBy("doc", "section").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(T.word_count(F.col("txt"))).alias("n_words"))


@query(f"""WITH {ELEMENTS}, c AS (SELECT DISTINCT chunk_id, doc, el_start, el_end, title, heading FROM chunks),
r AS (SELECT doc, pos, CASE WHEN tag = 'li' THEN '- ' || txt WHEN tag IN ('h1','h2','h3','h4') THEN '## ' || txt ELSE txt END AS line FROM el)
SELECT chunk_id, md5(coalesce(c.title || coalesce(' - ' || heading, '') || chr(10), '') || string_agg(line, chr(10) ORDER BY pos)) AS text_md5
FROM c JOIN r ON r.doc = c.doc AND r.pos >= el_start AND r.pos < el_end GROUP BY chunk_id, c.title, heading""")
def chunk_texts(spark, sf_dir):
    """The index text of each chunk: title and heading, then its elements as rendered."""
    c = table(spark, sf_dir, "chunks").select("chunk_id", "doc", "el_start", "el_end", "title", "heading").distinct()
    lines = pages(spark, sf_dir).select("doc", F.transform("elements", T.rendered).alias("lines"))
    body = F.array_join(F.slice("lines", F.col("el_start") + 1, F.col("el_end") - F.col("el_start")), "\n")
    head = F.coalesce(F.concat("title", F.coalesce(F.concat(F.lit(" - "), "heading"), F.lit("")), F.lit("\n")), F.lit(""))
    return c.join(lines, "doc").where("el_start < el_end AND el_start < size(lines)").select("chunk_id", F.md5(F.concat(head, body)).alias("text_md5"))


def _packing_sql(budget: int, section: bool) -> str:
    top = " OR e.tag IN ('h1','h2')" if section else ""
    return f"""WITH RECURSIVE {ELEMENTS}, e AS (SELECT doc, pos, tag, {WORDS.format('txt')} AS w FROM el),
fold(doc, pos, idx, total) AS (SELECT doc, pos, 0::BIGINT, w FROM e WHERE pos = 0
 UNION ALL SELECT e.doc, e.pos, CASE WHEN f.total + e.w > {budget}{top} THEN f.idx + 1 ELSE f.idx END, CASE WHEN f.total + e.w > {budget}{top} THEN e.w ELSE f.total + e.w END
 FROM fold f JOIN e ON e.doc = f.doc AND e.pos = f.pos + 1)
SELECT f.doc, f.idx, min(f.pos) AS el_start, max(f.pos) + 1 AS el_end, sum(w)::BIGINT AS n_words FROM fold f JOIN e USING (doc, pos) GROUP BY f.doc, f.idx"""


def _packable(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("doc", F.transform("elements", lambda e: T.word_count(T.text_of(e))).alias("words"), F.transform("elements", T.tag_of).alias("tags"))


@query(_packing_sql(150, False))
def chunk_fixed_150(spark, sf_dir):
    """Pages packed blindly into chunks of 150 words."""
    return packed(_packable(spark, sf_dir), "doc", 150)


@query(f"""WITH RECURSIVE {ELEMENTS}, e AS (SELECT doc, pos, tag, {WORDS.format('txt')} AS w FROM el),
pr AS (SELECT *, sum(w) OVER w AS cum, pos - 1 - coalesce(max(CASE WHEN tag NOT IN ('h1','h2','h3','h4') THEN pos END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS heads FROM e WINDOW w AS (PARTITION BY doc ORDER BY pos)),
l AS (SELECT doc, list(cum ORDER BY pos) AS cums FROM pr GROUP BY doc),
fold(doc, pos, start) AS (SELECT doc, 0::BIGINT, 0::BIGINT FROM l UNION ALL SELECT p.doc, p.pos, CASE WHEN p.pos > f.start AND (p.cum - coalesce(cums[f.start], 0) > 100 OR p.tag IN ('h1','h2')) THEN p.pos - least(p.heads, p.pos - 1 - f.start) ELSE f.start END
 FROM fold f JOIN pr p ON p.doc = f.doc AND p.pos = f.pos + 1 JOIN l ON l.doc = f.doc),
st AS (SELECT doc, start, row_number() OVER w - 1 AS idx, lead(start) OVER w AS nxt FROM (SELECT DISTINCT doc, start FROM fold) WINDOW w AS (PARTITION BY doc ORDER BY start))
SELECT doc, idx, start AS el_start, coalesce(nxt, len(cums)) AS el_end, (cums[coalesce(nxt, len(cums))] - coalesce(cums[start], 0))::BIGINT AS n_words FROM st JOIN l USING (doc)""")
def chunk_section_100(spark, sf_dir):
    """Pages packed into chunks of 100 words that open at top headings and never end with a heading."""
    return packed(_packable(spark, sf_dir), "doc", 100, section=True)


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, max(length(s))::BIGINT AS longest, md5(string_agg(s, chr(1) ORDER BY pos)) AS sentences_md5 FROM sents GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    """Documents cut into sentences."""
    d = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"), F.md5(F.array_join("s", "\u0001")).alias("sentences_md5"))


@query(rf"""WITH RECURSIVE {SENTENCES}, e AS (SELECT doc_id, pos, {WORDS.format('s')} AS w FROM sents),
fold(doc_id, pos, idx, total) AS (SELECT doc_id, pos, 0::BIGINT, w FROM e WHERE pos = 0
 UNION ALL SELECT e.doc_id, e.pos, CASE WHEN f.total + e.w > 140 THEN f.idx + 1 ELSE f.idx END, CASE WHEN f.total + e.w > 140 THEN e.w ELSE f.total + e.w END
 FROM fold f JOIN e ON e.doc_id = f.doc_id AND e.pos = f.pos + 1),
g AS (SELECT f.doc_id, f.idx, min(f.pos) AS a, max(f.pos) + 1 AS b, sum(w) AS n FROM fold f JOIN e USING (doc_id, pos) GROUP BY f.doc_id, f.idx),
m AS (SELECT *, max(idx) OVER (PARTITION BY doc_id) AS last FROM g),
k AS (SELECT doc_id, CASE WHEN idx = last AND idx > 0 AND n < 50 THEN idx - 1 ELSE idx END AS idx, a, b, n FROM m)
SELECT doc_id, idx, min(a) AS s_start, max(b) AS s_end, sum(n)::BIGINT AS n_words FROM k GROUP BY doc_id, idx""")
def chunk_sentence_140(spark, sf_dir):
    """Documents packed into chunks of whole sentences; a short last chunk joins the one before."""
    d = documents(spark, sf_dir).select("doc_id", F.transform(T.sentences(F.col("text")), T.word_count).alias("words"))
    return packed_sentences(d, "doc_id")


@query(f"WITH {DOCS}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM docs) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def vocabulary(spark, sf_dir):
    """Term and document frequency of every token."""
    per = documents(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"""WITH {DOCS} SELECT source, source_type, count(*) AS n_documents, count(text) AS n_texts, count(DISTINCT publisher) AS n_publishers,
round(avg({WORDS.format('text')}), 6) AS mean_words, max({WORDS.format('text')}) AS max_words FROM docs GROUP BY GROUPING SETS ((source), (source_type), ())""")
def corpus_stats(spark, sf_dir):
    """Counts and words per source, per source type and in all."""
    d = documents(spark, sf_dir).withColumn("w", T.word_count(F.col("text")))
    return d.groupingSets([[F.col("source")], [F.col("source_type")], []], "source", "source_type").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count("text").alias("n_texts"), F.count_distinct("publisher").alias("n_publishers"), F.round(F.avg("w"), 6).alias("mean_words"), F.max("w").alias("max_words"))


SQUAD = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '[ \t\n\r\f\x0B]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"""


@query(rf"""WITH c AS (SELECT cell_id, any_value(answers[1].answer) AS a, any_value(text) AS t FROM result_cells GROUP BY cell_id)
SELECT cell_id, {SQUAD.format('a')} AS answer_normal, contains(' ' || {SQUAD.format('t')} || ' ', ' ' || {SQUAD.format('a')} || ' ') AS stands_in_reply FROM c WHERE a IS NOT NULL""")
def answer_normal_forms(spark, sf_dir):
    """First answers in normal form, and whether the raw reply holds them at token boundaries."""
    c = table(spark, sf_dir, "result_cells").groupBy("cell_id").agg(F.first(F.get("answers.answer", F.lit(0))).alias("a"), F.first("text").alias("t"))
    return c.where("a IS NOT NULL").select("cell_id", T.squad_normal(F.col("a")).alias("answer_normal"), T.holds_tokens(F.col("t"), F.col("a")).alias("stands_in_reply"))


@query(rf"""WITH {DOCS}, f AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '(\d),(\d{{3}})', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda x: regexp_replace(regexp_replace(x, '(\.\d*[1-9])0+$', '\1'), '\.0+$', '')))) AS v FROM docs WHERE text IS NOT NULL)
SELECT doc_id, len(v)::BIGINT AS n_figures, array_to_string(v, ' ') AS figures FROM f""")
def document_figures(spark, sf_dir):
    """The distinct figures of each document."""
    d = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.array_sort(T.figures(F.col("text"))).alias("v"))
    return d.select("doc_id", F.size("v").cast("bigint").alias("n_figures"), F.array_join("v", " ").alias("figures"))


SQUEEZE = rf"trim(regexp_replace({{}}, '[{SPACE}]+', ' ', 'g'))"


@query(f"""WITH {ELEMENTS}, l AS (SELECT doc, title, pos, {SQUEEZE.format('txt')} AS t FROM el WHERE NOT regexp_matches(txt, '[<&]'))
SELECT doc, {SQUEEZE.format("coalesce(max(title), '')")} AS title, count(*) FILTER (t <> '') AS n_lines, md5(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (t <> ''), '')) AS text_md5 FROM l GROUP BY doc""")
def html_pages(spark, sf_dir):
    """Pages written as HTML with navigation, scripts and a footer around them, and read back: title, lines and text."""
    e = elements(spark, sf_dir).where(~F.col("txt").rlike("[<&]"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag", "txt"))), lambda x: F.concat(F.lit("<"), x["tag"], F.lit(">"), x["txt"], F.lit("</"), x["tag"], F.lit(">"))), "")
    page = F.concat(F.lit("<html><head><title>"), F.coalesce(F.max("title"), F.lit("")), F.lit("</title><style>p {}</style></head><body><nav><ul><li>Menu</ul></nav><main>"), body, F.lit("</main><footer><p>Imprint</footer><script>1 < 2</script></body></html>"))
    read = e.groupBy("doc").agg(page.alias("html")).select("doc", html_text("html").alias("r"))
    lines = F.filter(F.split("r.text", "\n"), lambda x: x != "")
    return read.select("doc", F.col("r.title").alias("title"), F.size(lines).cast("bigint").alias("n_lines"), F.md5("r.text").alias("text_md5"))
