"""Scalar functions over texts, addresses, identifiers and vectors."""
from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quernstone.functions import outcomes as O
from quernstone.functions import text as T
from quernstone.operators import metrics as M
from quernstone.operators.chunking import packed_sentences
from quernstone.queries._registry import family
from quernstone.queries.evaluation import cells
from quernstone.queries.matching import LIST, MONTHS, chain
from quernstone.queries.pairs import gold
from quernstone.queries.text import DOCS, SENTENCES, WORDS, documents
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()

SQ = lambda c: f"trim(regexp_replace({c}, '[{T.SPACE}]+', ' ', 'g'))"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{T.SPACE}]+", " "))


# Words without content and one word for several, in the comparison of a rule and its carve-out.
AUDIT_STOP = "the a an and or of to in on for is are be by with at as from this that it its any all you your we our may can will not no if".split()
SAME = {
    "charge": "fee", "charges": "fee", "fees": "fee", "cost": "fee", "costs": "fee", "payable": "pay", "pays": "pay", "paid": "pay", "accounts": "account", "cardholders": "card", "cardholder": "card",
    "cards": "card", "payments": "payment", "withdrawals": "withdrawal", "months": "monthly", "month": "monthly", "visas": "visa", "applicants": "applicant", "students": "student",
}
CARVE = r"(?i)\b(no|not|never|none|without|waived|exempt|free of|n't)\b"


def stem(w: Column) -> Column:
    """One of several words for a thing, without a plural s."""
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SAME.items() for x in kv]), w), w)
    return F.when((F.length(named) > 4) & F.endswith(named, F.lit("s")) & ~F.endswith(named, F.lit("ss")), F.regexp_replace(named, "s$", "")).otherwise(named)


def terms(text: Column) -> Column:
    """Distinct stems of words with content."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(*AUDIT_STOP) & (F.length(w) > 2))
    return F.array_distinct(F.transform(words, stem))


def contrast(a: Column, b: Column) -> Column:
    """How much two texts read as a rule and its opposite: shared terms of the smaller where the parity of negations differs, else 0."""
    odd = lambda t: F.regexp_count(t, F.lit(CARVE)) % 2
    ta, tb = terms(a), terms(b)
    least = F.least(F.size(ta), F.size(tb))
    return F.when((odd(a) != odd(b)) & (least > 0), F.size(F.array_intersect(ta, tb)) / least).otherwise(0.0)


STEM = "CASE WHEN length({0}) > 4 AND suffix({0}, 's') AND NOT suffix({0}, 'ss') THEN regexp_replace({0}, 's$', '') ELSE {0} END"
MAPPED = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in SAME.items()) + "}[w], w)"
TERMS = lambda c: f"list_distinct(list_transform(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: NOT list_contains({LIST(AUDIT_STOP)}, w) AND length(w) > 2), lambda w: {MAPPED}), lambda w: {STEM.format('w')}))"


@query(f"""WITH u AS (SELECT instance_id, unnest(p) AS x FROM (SELECT instance_id, any_value(passages) AS p FROM gold_instances GROUP BY instance_id)), pr AS (SELECT a.instance_id, a.x.id AS i, b.x.id AS j, coalesce(a.x.text, '') AS ti, coalesce(b.x.text, '') AS tj FROM u a JOIN u b ON a.instance_id = b.instance_id AND a.x.id < b.x.id),
k AS (SELECT *, {TERMS('ti')} AS ta, {TERMS('tj')} AS tb, len(regexp_extract_all(ti, '{CARVE.replace("'", "''")}')) % 2 AS oa, len(regexp_extract_all(tj, '{CARVE.replace("'", "''")}')) % 2 AS ob FROM pr),
c AS (SELECT instance_id, i, j, round(CASE WHEN oa <> ob AND least(len(ta), len(tb)) > 0 THEN len(list_intersect(ta, tb)) / least(len(ta), len(tb)) ELSE 0 END, 6)::DOUBLE AS contrast FROM k) SELECT *, CASE WHEN contrast >= 0.5 THEN 'high' WHEN contrast >= 0.2 THEN 'medium' ELSE 'low' END AS risk FROM c""")
def passage_contrast(spark, sf_dir):
    """How much two passages of a record read as a rule and its carve-out, and the risk that follows."""
    from quernstone.operators.pairs import passage_pairs

    p = passage_pairs(gold(spark, sf_dir)).select("instance_id", F.col("doc_i").alias("i"), F.col("doc_j").alias("j"), F.round(contrast(F.col("text_i"), F.col("text_j")), 6).alias("contrast"))
    return p.withColumn("risk", F.when(F.col("contrast") >= 0.5, "high").when(F.col("contrast") >= 0.2, "medium").otherwise("low"))


@query(r"""WITH c AS (SELECT DISTINCT chunk_id FROM chunks) SELECT chunk_id, try_cast(regexp_extract(chunk_id, '(\d+)$', 1) AS BIGINT) AS position, regexp_extract(chunk_id, '^[a-z]+\d+', 0) AS page FROM c""")
def chunk_positions(spark, sf_dir):
    """The page and the place that a chunk's identifier names."""
    c = table(spark, sf_dir, "chunks").select("chunk_id").distinct()
    return c.select("chunk_id", F.regexp_extract("chunk_id", r"(\d+)$", 1).try_cast("bigint").alias("position"), F.regexp_extract("chunk_id", r"^[a-z]+\d+", 0).alias("page"))


# Cues of a rule and of an exception in the ranking of candidate pairs.
RULE_CUES = r"(?i)\b(?:must|need(?:s)? to|required|will be charged|fee|charge|cost|pay|only|eligible|entitled|can(?:not)?|may not|not allowed|permitted|limit)\b"
EXCEPT_CUES = r"(?i)\b(?:unless|except|exempt(?:ed)?|waived|does not apply|do not apply|will not (?:need|have|be charged)|not (?:need|required|charged)|instead|however|if you (?:are|have|hold)|only if|apart from|free of charge|no fee|no charge)\b"
LONG = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z''-]{{2,}}'), lambda w: NOT list_contains({LIST(T.STOP_WORDS)}, w)))"


@query(f"""WITH u AS (SELECT instance_id, unnest(p) AS x FROM (SELECT instance_id, any_value(passages) AS p FROM gold_instances GROUP BY instance_id)), pr AS (SELECT a.instance_id, a.x.id AS i, b.x.id AS j, coalesce(a.x.text, '') AS ti, coalesce(b.x.text, '') AS tj FROM u a JOIN u b ON a.instance_id = b.instance_id AND a.x.id < b.x.id),
k AS (SELECT *, regexp_matches(ti, '{RULE_CUES}') AS ra, regexp_matches(tj, '{RULE_CUES}') AS rb, regexp_matches(ti, '{EXCEPT_CUES}') AS ea, regexp_matches(tj, '{EXCEPT_CUES}') AS eb, {LONG('ti')} AS ta, {LONG('tj')} AS tb FROM pr),
c AS (SELECT *, CASE WHEN (ra AND eb) OR (rb AND ea) THEN 1.0 WHEN (ra OR rb) AND (ea OR eb) THEN 0.4 ELSE 0 END AS comp, len(list_intersect(ta, tb)) / greatest(1, least(len(ta), len(tb))) AS o FROM k) SELECT instance_id, i, j, round(CASE WHEN comp = 0 THEN 0 ELSE comp + 0.5 * least(1, 2 * o) END, 6)::DOUBLE AS score FROM c""")
def candidate_scores(spark, sf_dir):
    """Score of two passages as candidates: a rule cue on one side and an exception cue on the other, overlap only to break ties."""
    from quernstone.operators.pairs import passage_pairs

    p = passage_pairs(gold(spark, sf_dir))
    a, b = F.col("text_i"), F.col("text_j")
    long = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z'-]{2,})"), F.lit(1)), lambda w: ~w.isin(*T.STOP_WORDS)))
    ra, rb, ea, eb = a.rlike(RULE_CUES), b.rlike(RULE_CUES), a.rlike(EXCEPT_CUES), b.rlike(EXCEPT_CUES)
    comp = F.when((ra & eb) | (rb & ea), 1.0).when((ra | rb) & (ea | eb), 0.4).otherwise(0.0)
    o = F.size(F.array_intersect(long(a), long(b))) / F.greatest(F.lit(1), F.least(F.size(long(a)), F.size(long(b))))
    return p.select("instance_id", F.col("doc_i").alias("i"), F.col("doc_j").alias("j"), F.round(F.when(comp == 0, 0.0).otherwise(comp + 0.5 * F.least(F.lit(1.0), 2 * o)), 6).alias("score"))


FIRST_CUE = "list_filter(" + LIST(T.EXCEPTION_CUES) + ", lambda c: contains(lower(s), c))[1]"
FRAGMENT = r"(?i)^\s*(?:\(?[a-z0-9]{1,3}[.)]\s|[-•*]\s|and\b|or\b|but\b|which\b|that\b|where\b|whose\b|including\b)"


@query(rf"""WITH {SENTENCES}, c AS (SELECT doc_id, pos, s, {FIRST_CUE} AS cue FROM sents WHERE length(s) BETWEEN 80 AND 340), b AS (SELECT *, trim(substr(s, 1, strpos(lower(s), cue) - 1)) AS before, substr(lower(s), 1, 90) AS k FROM c WHERE cue IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM b WHERE length(before) >= 40 AND NOT regexp_matches(before, '{FRAGMENT}')) SELECT doc_id, pos, cue FROM r WHERE r = 1""")
def split_candidates(spark, sf_dir):
    """Sentences that state a rule and its carve-out together: the first cue with enough before it; of sentences that begin alike the first."""
    s = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).where("length(s) BETWEEN 80 AND 340")
    low = F.lower("s")
    cue = F.get(F.filter(F.array(*map(F.lit, T.EXCEPTION_CUES)), lambda c: F.contains(low, c)), F.lit(0))
    s = s.withColumn("cue", cue).where("cue IS NOT NULL").withColumn("before", F.trim(F.expr("substring(s, 1, instr(lower(s), cue) - 1)")))
    s = s.where((F.length("before") >= 40) & ~F.col("before").rlike(FRAGMENT))
    key = F.xxhash64(F.substring(low, 1, 90))
    return s.groupBy(key.alias("k")).agg(F.min(F.struct("doc_id", "pos", "cue")).alias("f")).select("f.doc_id", F.col("f.pos").cast("bigint").alias("pos"), "f.cue")


# Kinds of source by words in a name and in the first 400 letters, in order.
KINDS = (("government_guidance", (".gov", "gov.uk"), ("government",)), ("faq", ("faq",), ("frequently asked",)), ("product_terms", ("terms", "conditions", "tariff", "fees"), ("terms and conditions",)), ("amendment", ("amend",), ("amendment",)), ("official_policy", ("policy",), ("policy",)))


@query(f"""WITH {DOCS}, k AS (SELECT doc_id, lower(coalesce(url, '')) AS n, lower(substr(coalesce(text, ''), 1, 400)) AS h FROM docs) SELECT CASE {' '.join("WHEN " + " OR ".join([f"contains(n, '{x}')" for x in a] + [f"contains(h, '{x}')" for x in b]) + f" THEN '{k}'" for k, a, b in KINDS)} ELSE 'unknown' END AS kind, count(*) AS n_documents FROM k GROUP BY 1""")
def guessed_source_types(spark, sf_dir):
    """The kind of source that a document's address and opening suggest (the opening is what the rule reads)."""
    n, h = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 400))
    k = F.lit("unknown")
    for name, a, b in reversed(KINDS):
        test = F.lit(False)
        for x in a:
            test = test | F.contains(n, F.lit(x))
        for x in b:
            test = test | F.contains(h, F.lit(x))
        k = F.when(test, name).otherwise(k)
    return documents(spark, sf_dir).groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n_documents"))


ISO = r"\b((?:20\d\d|19\d\d)-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?)\b"
WRITTEN = rf"(?i)\b(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+((?:19|20)\d\d)\b"


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, coalesce(text, '') || ' ' || coalesce(url, '') AS t FROM docs), d AS (SELECT doc_id, regexp_extract(t, '{ISO}', 1) AS iso, regexp_extract(t, '{WRITTEN}', 1) AS d, lower(regexp_extract(t, '{WRITTEN}', 2)) AS m, regexp_extract(t, '{WRITTEN}', 3) AS y FROM t)
SELECT doc_id, CASE WHEN iso <> '' THEN iso WHEN y <> '' THEN y || '-' || lpad(list_position({LIST([m.lower() for m in MONTHS])}, m)::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') END AS date FROM d""")
def found_dates(spark, sf_dir):
    """The first ISO date of each document and its address, else the first date written out; null where there is none."""
    d = documents(spark, sf_dir).withColumn("t", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))))
    iso, part = F.regexp_extract("t", ISO, 1), lambda i: F.regexp_extract("t", WRITTEN, i)
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(part(2))).cast("string")
    return d.select("doc_id", F.when(iso != "", iso).when(part(3) != "", F.concat_ws("-", part(3), F.lpad(month, 2, "0"), F.lpad(part(1), 2, "0"))).alias("date"))


PARAS = rf"""{DOCS}, pa AS (SELECT doc_id, pi, {SQ('p')} AS p FROM (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, unnest(range(len(string_split_regex(text, '\n\s*\n')))) AS pi FROM docs WHERE text IS NOT NULL)),
ps AS (SELECT doc_id, pi, s, row_number() OVER (PARTITION BY doc_id, pi ORDER BY si) - 1 AS pos FROM (SELECT doc_id, pi, unnest(string_split(regexp_replace(p, '([.!?]) +([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s, unnest(range(len(string_split(regexp_replace(p, '([.!?]) +([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))))) AS si FROM pa WHERE p <> '')),
pe AS (SELECT doc_id, pi, pos, s, {WORDS.format('s')} AS w FROM ps), fold(doc_id, pi, pos, idx, total) AS (SELECT doc_id, pi, pos, 0::BIGINT, w FROM pe WHERE pos = 0 UNION ALL SELECT e.doc_id, e.pi, e.pos, CASE WHEN f.total + e.w > 70 THEN f.idx + 1 ELSE f.idx END, CASE WHEN f.total + e.w > 70 THEN e.w ELSE f.total + e.w END FROM fold f JOIN pe e ON e.doc_id = f.doc_id AND e.pi = f.pi AND e.pos = f.pos + 1)"""


@query(f"""WITH RECURSIVE {PARAS}, g AS (SELECT f.doc_id, f.pi, f.idx, sum(w) AS n, string_agg(s, ' ' ORDER BY f.pos) AS t FROM fold f JOIN pe USING (doc_id, pi, pos) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pi, idx) - 1 AS i FROM g WHERE n >= 4) SELECT doc_id::VARCHAR || ':' || i AS passage_id, n::BIGINT AS n_words, md5(t) AS text_md5 FROM k""")
def ingested_passages(spark, sf_dir):
    """Documents cut into passages of up to seventy words that never cross a paragraph, those under four words dropped, with ids."""
    paras = F.filter(F.transform(F.split("text", r"\n\s*\n"), squeezed), lambda p: p != "")
    d = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(paras).alias("pi", "p"))
    d = d.withColumn("s", F.split("p", r"""(?<=[.!?]) +(?=[A-Z0-9"'(])""")).withColumn("key", F.concat_ws(":", "doc_id", "pi"))
    cuts = packed_sentences(d.select("key", F.transform("s", T.word_count).alias("words")), "key", target=70, least=0)
    g = cuts.join(d.select("key", "doc_id", "pi", "s"), "key").where("n_words >= 4")
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("pi", "idx")) - 1
    text = F.array_join(F.slice("s", (F.col("s_start") + 1).cast("int"), (F.col("s_end") - F.col("s_start")).cast("int")), " ")
    return g.select(F.concat_ws(":", "doc_id", i).alias("passage_id"), "n_words", F.md5(text).alias("text_md5"))


CONDITIONED = r"(?i)\b(?:if|unless|when|where|whenever|provided|only if|who (?:is|are|has|have|holds|hold)|holders? of|\w+[- ]tier|in the case of|in cases where|as an? \w+)\b"
EVERYONE = r"(?i)\b(?:all|every|everyone|any|each|anyone|regardless)\b"
HOWEVER = r"(?i)^\s*(?:however|but|although|except|otherwise)[,\s]+"


@query(rf"""WITH {SENTENCES}, c AS (SELECT source, trim(regexp_replace({chain('s', [(O.CITATION, '')])}, '{HOWEVER}', '')) AS s FROM sents), k AS (SELECT source, regexp_matches(s, '{CONDITIONED}') AS conditioned, regexp_matches(s, '{EVERYONE}') AS everyone FROM c WHERE regexp_matches(s, '[a-zA-Z0-9]')) SELECT source, count(*) AS n_claims, count(*) FILTER (conditioned) AS n_conditioned, count(*) FILTER (everyone AND NOT conditioned) AS n_general FROM k GROUP BY source""")
def claims_per_source(spark, sf_dir):
    """Sentences as claims, connectives and citations taken off: those under a condition and those for everyone."""
    s = documents(spark, sf_dir).select("source", F.explode(T.sentences(F.col("text"))).alias("s"))
    s = s.withColumn("s", F.trim(F.regexp_replace(O.strip_citations(F.col("s")), HOWEVER, ""))).where(F.col("s").rlike("[a-zA-Z0-9]"))
    c, e = F.col("s").rlike(CONDITIONED), F.col("s").rlike(EVERYONE)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_claims"), M.count_if(c).alias("n_conditioned"), M.count_if(e & ~c).alias("n_general"))


@query(r"""WITH c AS (SELECT system, coalesce(any_value(answers)[1].answer, '') AS a FROM result_cells GROUP BY cell_id, system), k AS (SELECT system, a, list_filter(string_split(regexp_replace(trim(a), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM c),
q AS (SELECT system, trim(a) <> '' AND len(list_filter(s, lambda x: suffix(trim(x), '?'))) > 0 AND len(list_filter(s, lambda x: suffix(trim(x), '?'))) >= len(s) / 2 AND NOT regexp_matches(a, '\d') AS asks FROM k) SELECT system, count(*) AS n, count(*) FILTER (asks) AS n_asking FROM q GROUP BY system""")
def clarifications(spark, sf_dir):
    """Answers that only ask back."""
    a = F.trim(F.coalesce(F.get("answers.answer", F.lit(0)), F.lit("")))
    c = cells(spark, sf_dir).select("system", a.alias("a")).withColumn("s", F.filter(F.split("a", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""))
    q = F.size(F.filter("s", lambda x: F.endswith(F.trim(x), F.lit("?"))))
    asks = (F.col("a") != "") & (q > 0) & (q >= F.size("s") / 2) & ~F.col("a").rlike(r"\d")
    return c.groupBy("system").agg(F.count(F.lit(1)).alias("n"), M.count_if(asks).alias("n_asking"))


FLAT = lambda c: SQ(f"translate({c}, '–—‘’“”', '--''''\"\"')")


def flattened(c: Column) -> Column:
    """Dashes and quotes of one kind, white space squeezed."""
    return squeezed(F.translate(c, "–—‘’“”", "--''\"\""))


@query(rf"""WITH {DOCS}, f AS (SELECT doc_id, text, {FLAT('text')} AS t FROM docs WHERE text IS NOT NULL), s AS (SELECT doc_id, t, length(t) // 3 AS a, length(t) // 3 AS n FROM f), r AS (SELECT doc_id, t, substr(t, a + 1, n) AS span, sha256(substr(t, a + 1, n)) AS sha FROM s)
SELECT doc_id, strpos(t, span) - 1 AS start, length(span) AS n_chars, sha, sha256(substr(t, strpos(t, span), length(span))) = sha AS restored FROM r WHERE length(span) > 0""")
def redaction_round_trip(spark, sf_dir):
    """A stretch of each flattened document is located by its text, released as offsets and a hash, and restored from them."""
    d = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", flattened(F.col("text")).alias("t")).withColumn("n", F.floor(F.length("t") / 3).cast("int"))
    d = d.withColumn("span", F.expr("substring(t, n + 1, n)")).where("length(span) > 0").withColumn("at", F.expr("instr(t, span)"))
    sha = F.sha2("span", 256)
    return d.select("doc_id", (F.col("at") - 1).cast("bigint").alias("start"), F.length("span").cast("bigint").alias("n_chars"), sha.alias("sha"), (F.sha2(F.expr("substring(t, at, length(span))"), 256) == sha).alias("restored"))


@query(rf"""WITH {DOCS}, h AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, url FROM docs) SELECT CASE WHEN url IS NULL OR host = '' THEN 'none' ELSE host END AS host, CASE WHEN starts_with(host, 'guid') OR contains(host, '.gov') THEN 'open' ELSE 'redact' END AS policy, count(*) AS n FROM h GROUP BY ALL""")
def host_policies(spark, sf_dir):
    """Whether texts of a host are released as they are or redacted."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    d = documents(spark, sf_dir).select(F.when(host == "", "none").otherwise(host).alias("host"))
    return d.groupBy("host", F.when(F.startswith("host", F.lit("guid")) | F.contains("host", F.lit(".gov")), "open").otherwise("redact").alias("policy")).agg(F.count(F.lit(1)).alias("n"))


RETRY = r"(?i)try again in\s+(?:(\d+)m)?\s*(\d+(?:\.\d+)?)\s*(ms|s)\b"


@query(rf"""WITH m AS (SELECT cell_id, CASE WHEN cell_id % 3 = 0 THEN 'busy, try again in ' || (cell_id % 4 + 1) || 'm' || (cell_id % 60) || '.5s' WHEN cell_id % 3 = 1 THEN 'Try again in ' || (any_value(prompt_tokens)) || 'ms' ELSE 'quota reached' END AS t FROM result_cells WHERE latency_s IS NOT NULL GROUP BY cell_id)
SELECT cell_id, CASE WHEN regexp_matches(t, '{RETRY}') THEN round(coalesce(try_cast(regexp_extract(t, '{RETRY}', 1) AS DOUBLE), 0) * 60 + regexp_extract(t, '{RETRY}', 2)::DOUBLE / CASE WHEN lower(regexp_extract(t, '{RETRY}', 3)) = 'ms' THEN 1000 ELSE 1 END, 6) END AS seconds FROM m""")
def retry_delays(spark, sf_dir):
    """Seconds that a provider's message asks to wait; null where it names none."""
    part = lambda i: F.regexp_extract("t", RETRY, i)
    i = F.col("cell_id")
    t = F.when(i % 3 == 0, F.concat(F.lit("busy, try again in "), (i % 4 + 1).cast("string"), F.lit("m"), (i % 60).cast("string"), F.lit(".5s"))).when(i % 3 == 1, F.concat(F.lit("Try again in "), F.col("prompt_tokens").cast("string"), F.lit("ms"))).otherwise("quota reached")
    m = cells(spark, sf_dir).where("latency_s IS NOT NULL").select("cell_id", t.alias("t"))
    wait = F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 60 + part(2).try_cast("double") / F.when(F.lower(part(3)) == "ms", 1000).otherwise(1)
    return m.select("cell_id", F.when(F.col("t").rlike(RETRY), F.round(wait, 6)).alias("seconds"))


@query("""WITH p AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events), n AS (SELECT coalesce(k, 'none') AS k, count(*) AS n FROM p GROUP BY 1) SELECT count(*) AS n_values, sum(n)::BIGINT AS n_events, coalesce(sum(n) FILTER (k = 'none'), 0)::BIGINT AS n_without FROM n""")
def json_paths(spark, sf_dir):
    """Values found by a path in the JSON of events."""
    n = table(spark, sf_dir, "events").select(F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_events"), F.coalesce(F.sum(F.when(F.col("k") == "none", F.col("n"))), F.lit(0)).alias("n_without"))


@query("""WITH c AS (SELECT DISTINCT system, model, strategy, ranker, words FROM result_cells) SELECT substr(sha256(concat_ws(chr(31), 'model=' || model, 'ranker=' || ranker, 'strategy=' || strategy, 'system=' || system, 'words=' || words)), 1, 12) AS fingerprint, system, model, strategy, ranker, words FROM c""")
def run_fingerprints(spark, sf_dir):
    """A short hash of each run's settings, in the order of their names."""
    c = table(spark, sf_dir, "result_cells").select("system", "model", "strategy", "ranker", "words").distinct()
    text = F.concat_ws("\u001f", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in ("model", "ranker", "strategy", "system", "words")])
    return c.select(F.substring(F.sha2(text, 256), 1, 12).alias("fingerprint"), "*")


@query(rf"""WITH {DOCS} SELECT doc_id, md5(translate(coalesce(title, ''), '–—‘’“”£€', '--''''""LE')) AS title_md5 FROM (SELECT doc_id, max(title) AS title FROM documents GROUP BY doc_id)""")
def console_titles(spark, sf_dir):
    """Titles in characters that any console shows."""
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("title").alias("title"))
    return d.select("doc_id", F.md5(F.translate(F.coalesce("title", F.lit("")), "–—‘’“”£€", "--''\"\"LE")).alias("title_md5"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e AS x, b.e AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT a, b, 3 * len(x) AS n_features, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] + z[2])), 6) AS sum_total, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 6) AS difference_total, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])), 6) AS product_total FROM p""")
def interaction_features(spark, sf_dir):
    """Sum, absolute difference and product of the vectors of two neighbours, as one array, with the totals of its thirds."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    p = e.select(F.col("vec_id").alias("a"), F.col("e").alias("x"), (F.col("vec_id") + 1).alias("b")).join(e.select(F.col("vec_id").alias("b"), F.col("e").alias("y")), "b")
    f = F.concat(F.zip_with("x", "y", lambda u, v: u + v), F.zip_with("x", "y", lambda u, v: F.abs(u - v)), F.zip_with("x", "y", lambda u, v: u * v))
    p = p.select("a", "b", f.alias("f"), F.size("x").alias("n"))
    third = lambda i: F.round(F.aggregate(F.slice("f", F.col("n") * i + 1, F.col("n")), F.lit(0.0), lambda s, v: s + v), 6)
    return p.select("a", "b", F.size("f").cast("bigint").alias("n_features"), third(0).alias("sum_total"), third(1).alias("difference_total"), third(2).alias("product_total"))


@query("""WITH g AS (SELECT instance_id, unnest(p) AS x FROM (SELECT instance_id, any_value(passages) AS p FROM gold_instances GROUP BY instance_id)) SELECT instance_id || '::' || x.id AS id, md5(min(coalesce(x.text, ''))) AS text_md5, count(*) AS n FROM g GROUP BY 1""")
def corpus_from_records(spark, sf_dir):
    """Passages of all records under ids of their own; of one id the least text stands."""
    p = gold(spark, sf_dir).select("instance_id", F.explode("passages").alias("x"))
    return p.groupBy(F.concat_ws("::", "instance_id", "x.id").alias("id")).agg(F.md5(F.min(F.coalesce("x.text", F.lit("")))).alias("text_md5"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT system || '/' || model AS run, strategy AS kind, max(answered_at) AS created, count(DISTINCT cell_id) AS n FROM result_cells GROUP BY ALL) SELECT run, kind, n FROM r WHERE contains(run, 'top') OR contains(kind, 'top') ORDER BY created DESC, run, kind LIMIT 5 OFFSET 1""")
def run_listing(spark, sf_dir):
    """The second page of runs that a search finds, newest first."""
    r = table(spark, sf_dir, "result_cells").groupBy(F.concat_ws("/", "system", "model").alias("run"), F.col("strategy").alias("kind")).agg(F.max("answered_at").alias("created"), F.count_distinct("cell_id").alias("n"))
    return r.where(F.contains("run", F.lit("top")) | F.contains("kind", F.lit("top"))).orderBy(F.desc("created"), "run", "kind").offset(1).limit(5).select("run", "kind", "n")


@query("""WITH d AS (SELECT doc_id, max(publisher) AS publisher, max(fetched_at) AS newest, max(length(text)) AS n FROM documents GROUP BY doc_id) SELECT coalesce(publisher, 'none') AS collection, count(*) AS n_documents, sum(coalesce(n, 0))::BIGINT AS n_letters, epoch_us(max(newest)) AS newest_us FROM d GROUP BY 1""")
def collections(spark, sf_dir):
    """Collections with their documents and the newest of them."""
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("publisher").alias("publisher"), F.max("fetched_at").alias("at"), F.max(F.length("text")).alias("n"))
    return d.groupBy(F.coalesce("publisher", F.lit("none")).alias("collection")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_letters"), F.unix_micros(F.max("at").cast("timestamp")).alias("newest_us"))


BOILER = r"(?i)(cookie|javascript|skip to|sign in|read the full|last changed)"


@query(rf"""WITH {DOCS}, s AS (SELECT doc_id, {SQ('s')} AS s FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1))) AS s FROM docs WHERE text IS NOT NULL)) SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_letters FROM s WHERE length(s) >= 30 AND NOT regexp_matches(s, '{BOILER}') GROUP BY doc_id""")
def policy_sentences(spark, sf_dir):
    """Sentences of thirty letters or more without the words of navigation."""
    s = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.explode(F.split(F.regexp_replace("text", r"([.!?])\s+|\n+", "$1\u0001"), "\u0001")).alias("s")).withColumn("s", squeezed(F.col("s")))
    s = s.where((F.length("s") >= 30) & ~F.col("s").rlike(BOILER))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).cast("bigint").alias("n_letters"))
