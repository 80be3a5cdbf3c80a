"""Broken prompt and response pairs.

Replies are read as JSON, in a fence or in prose, or as plain text. Checks of termination, emptiness, copying and language label
what they can. Openings of the other replies are masked and gathered with the number of prompts and the share of replies that
cite evidence; distinct openings are clustered by an exact similarity of 0.8 of their words. An opening
that recurs across unrelated prompts, in replies that mostly cite nothing, is a refusal template; clusters with one lead of three
words count together, so a template is found whatever it says it declines. No list of phrases is used: a refusal whose opening no
other prompt got is not known as one. What the checks and templates leave is tested for termination (``endings``): an answer whose
last words nearly always go on elsewhere, or whose last word only begins a usual one, is truncated.

Defined results: null and blank replies are empty; no answer is no defect where the question is not answerable; a cell whose
question is missing is never a copy or in another language; repeated rows count once; empty tables give empty results; the
language model is fitted on at most ``per_language`` documents of each language.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.endings import ENDED, beginnings, masked_tokens, open_ends
from quernstone.plans.components import components
from quernstone.plans.materialize import materialize
from quernstone.plans.skew import salted_join
from quernstone.sources.tables import table

#: Openings are sets of words: of twelve, one altered leaves 11/13; with five-word shingles 0.8 could not be reached.
SIMILAR = 0.8
OPENING, LEAD = 12, 3
#: A template recurs across at least so many prompts, and at most this share of its replies cites evidence.
PROMPTS, CITING = 3, 0.5
#: Share of the question that the answer repeats, and of the answer that repeats the question.
COPIED, ONLY = 0.65, 0.85
#: Words of an answer are evidence of where answers end once they stand so often elsewhere.
ANSWERS = 3
#: By how many nats another language must be likelier than the question's.
MARGIN = 2.0

# Common function words of each language, yes and no among them.
COMMON = {
    "en": "yes no the of and to a in is it you that for on with as are be this not or by at from your have an can will if after before they do up must may how what which when i am".split(),
    "cy": "ie ydw nac na ni nid nad y yr yn i o a ac ar am at gan gyda heb er dros trwy wrth oddi ei eich eu chi os neu ond fel pan mae yw oes bydd oedd wedi hwn hon hyn hynny mae'r mae'n dim".split(),
    "pl": "tak nie i w z na do od po za się że o dla oraz ale lub czy jak jest są był być to ten ta te który przez przy nad bez jeśli gdy tylko już może ile mi mu".split(),
    "de": "ja nein das ist nicht der die den dem des ein eine und in zu mit von für auf sie er es wir ich kann wenn nach bei oder aber auch nur noch wird sind hat".split(),
    "fr": "oui non le la les des un une et de du à en pour avec sur que qui ne pas est ce il elle vous nous je si ou mais plus par dans sont c'est".split(),
    "es": "sí no el la los las un una y de del en para con por que se es son lo le su si o pero más como está este esta eso muy ya".split(),
}
# What stands for no answer.
PLACEHOLDERS = frozenset("- -- --- – — . .. ... … ? n/a na n.a. none null nil unknown tbd todo tba undefined empty blank [] {} \"\" '' [blank] [answer] <answer> answer xxx _ __ ___".split())
QUOTING = re.compile(r"^\W*(user question|the question is|question|you asked|you wrote|your question|prompt|user|q)\s*(was\s*)?[:\-–—]+\s*", re.I)
NOTICE = re.compile(r"^\W*(truncated\b|output (was )?(stopped|truncated|cut)|response (was )?(truncated|cut off)|finish_reason\W+length|max(imum)? tokens? (limit )?reached)|\[(truncated|cut off)\]", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def complete_json(text: str) -> bool:
    """Whether the braces and strings that begin in ``text`` also end in it."""
    depth, quoted, escaped = 0, False, False
    for ch in text[text.find("{") :]:
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth <= 0 and ch == "}":
                return True
    return depth <= 0 and not quoted


def language_model(samples: list[tuple[str, str]]) -> dict:
    """Word and letter-triple log-probabilities of each language, from (language, text) samples."""
    words = {k: Counter({w: 20 for w in v}) for k, v in COMMON.items()}
    for lang, text in samples:
        if lang in words:
            words[lang].update(w for w in WORD.findall(text) if not w[0].isupper() and not w[0].isdigit())
    langs = sorted(words)
    vocabulary = set().union(*words.values())
    triples = {k: Counter() for k in langs}
    for k in langs:
        for w, n in words[k].items():
            for i in range(len(w)):
                triples[k][f" {w} "[i : i + 3]] += min(n, 50)
    total = {k: sum(words[k].values()) for k in langs}
    t_total = {k: sum(triples[k].values()) for k in langs}
    every = set().union(*triples.values())
    return {
        "langs": langs,
        "words": {w: [math.log((words[k][w] + 0.05) / (total[k] + 0.05 * len(vocabulary))) for k in langs] for w in vocabulary if sum(words[k][w] for k in langs) > 1},
        "triples": {t: [math.log((triples[k][t] + 0.1) / (t_total[k] + 0.1 * len(every))) for k in langs] for t in every},
    }


def scores(model: dict, text: str) -> list[float]:
    """Log-likelihood of each language; names (capitals inside a sentence) and figures say nothing."""
    own = WORD.findall(text)
    if sum(w.isupper() for w in own) > len(own) / 2:  # shouted: case tells nothing
        own = [w.lower() for w in own]
    out = [0.0] * len(model["langs"])
    for i, w in enumerate(own):
        if w[0].isdigit() or (i and w[0].isupper()):
            continue
        w = w.lower().replace("’", "'")
        p = model["words"].get(w)
        if p is not None:
            out = [a + b for a, b in zip(out, p)]
        elif not i and own[0][0].isupper():
            continue
        else:
            for k in range(len(w)):
                p = model["triples"].get(f" {w} "[k : k + 3])
                if p is not None:
                    out = [a + 0.5 * b for a, b in zip(out, p)]
    return out


def copies(answer: str, question: str) -> bool:
    a, q = [w.lower() for w in WORD.findall(QUOTING.sub("", answer))], [w.lower() for w in WORD.findall(question)]
    if not a or not q:
        return False
    sa, sq = set(a), set(q)
    return sum(w in sa for w in q) / len(q) >= COPIED and sum(w in sq for w in a) / len(a) >= ONLY


def checks(text: str | None, answers: list[str], question: str | None, not_answerable: bool, model: dict, cache: dict) -> tuple[str | None, list[str]]:
    """The defect that the checks find, if any, and the answers of the reply."""
    raw = (text or "").strip()
    given = [a.strip() for a in answers if a and a.strip().lower() not in PLACEHOLDERS and a.strip()]
    json = "{" in raw
    if NOTICE.search(raw):
        return "truncated", []
    if json and not complete_json(raw):
        return "truncated", []
    said = given or ([] if json else [raw])
    reply = " ".join(said)
    if reply.lower() in PLACEHOLDERS or not reply:
        return (None if not_answerable else "empty"), []
    if question:
        if copies(reply, question):
            return "copies_question", said
        if question not in cache:
            cache[question] = scores(model, question)
        q = cache[question]
        a = scores(model, reply)
        at = max(range(len(q)), key=q.__getitem__)
        if max(a) - a[at] > MARGIN:
            return "other_language", said
    return None, said


def label_checks(cells: DataFrame, model: dict) -> DataFrame:
    """``cells`` (cell_id, text, answers array<string>, n_evidence, question, not_answerable) to (cell_id, defect, said array<string>, prompt, cites)."""
    shared = cells.sparkSession.sparkContext.broadcast(model)  # the words of a bounded sample
    kind = cells.schema["cell_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for b in batches:
            if len(cache) > 100_000:
                cache.clear()
            found = [checks(t, list(a) if a is not None else [], q, bool(n), m, cache) for t, a, q, n in zip(b["text"], b["answers"], b["question"], b["not_answerable"])]
            yield pd.DataFrame({"cell_id": b["cell_id"], "defect": [f[0] for f in found], "said": [f[1] for f in found], "prompt": b["prompt"], "cites": b["n_evidence"] > 0})

    return cells.select("cell_id", "text", "answers", "n_evidence", "question", "not_answerable", F.xxhash64("question").alias("prompt")).mapInPandas(
        run, f"cell_id {kind}, defect string, said array<string>, prompt bigint, cites boolean"
    )


def opening(reply: Column) -> Column:
    """The first words in lower case, figures as 9."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(reply, r"\d[\d,.]*", "9")), r"[^\p{L}\p{N}' ]+", " ")
    return F.array_join(F.slice(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), 1, OPENING), " ")


def similar_openings(seen: DataFrame) -> DataFrame:
    """``seen`` (opening, sh: hashes of its distinct words) to links (a, b) whose components are those of all pairs with a similarity
    of ``SIMILAR``. Sets of at most 13 words are so alike only if one lacks one or two words of the other, or each lacks one; so
    they share a key, the words without none, one or two, and all of a key that are alike are linked to one of them."""
    d = seen.select(F.xxhash64("opening").alias("o"), F.array_sort("sh").alias("sh"))
    k = F.size("sh")

    def less(drop: int, keys: Column) -> Column:
        return F.transform(keys, lambda h: F.struct(h.alias("key"), F.lit(drop).alias("drop"), (k - drop).alias("k")))

    one = F.transform("sh", lambda w: F.xxhash64(F.array_remove("sh", w)))
    two = F.flatten(F.transform("sh", lambda w: F.transform(F.filter("sh", lambda x: x > w), lambda x: F.xxhash64(F.array_remove(F.array_remove("sh", w), x)))))
    none = F.array().cast("array<bigint>")
    keys = F.concat(less(0, F.array(F.xxhash64("sh"))), less(1, F.when(k - 1 >= SIMILAR * k, one).otherwise(none)), less(2, F.when(k - 2 >= SIMILAR * k, two).otherwise(none)))
    keys = materialize(d.select("o", F.explode(keys).alias("x")).select("o", "x.*"), "opening_keys")
    swapped = (F.col("drop") == 1) & (F.col("k") >= SIMILAR * (F.col("k") + 2))
    heads = keys.groupBy("key").agg(F.min(F.when(F.col("drop") == 0, F.col("o"))).alias("whole"), F.min(F.when(swapped, F.col("o"))).alias("swap"), F.count(F.lit(1)).alias("n"))
    heads = heads.where("n > 1").drop("n")
    both = keys.join(heads, "key").select("o", F.explode(F.array("whole", F.when(swapped, F.col("swap")))).alias("p")).where("p IS NOT NULL AND p <> o").distinct()
    name = seen.select(F.xxhash64("opening").alias("o"), F.col("opening").alias("a"))
    return both.join(name, "o").join(name.select(F.col("o").alias("p"), F.col("a").alias("b")), "p").select("a", "b").distinct()


def refusal_templates(replies: DataFrame) -> DataFrame:
    """``replies`` (opening, prompt, cites) to (opening): openings of refusal templates."""
    seen = replies.where("opening <> ''").groupBy("opening", "prompt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cites").cast("bigint")).alias("cited"))
    seen = seen.groupBy("opening").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n").alias("n"), F.sum("cited").alias("cited"))
    seen = materialize(seen.withColumn("sh", F.array_distinct(F.transform(F.split("opening", " "), lambda w: F.xxhash64(w)))), "openings")
    links = similar_openings(seen.select("opening", "sh"))
    named = components(links).withColumnRenamed("node", "opening")
    clustered = seen.join(named, "opening", "left").select("opening", "prompts", "n", "cited", F.coalesce("component", "opening").alias("cluster"))
    by_cluster = clustered.groupBy("cluster").agg(F.sum("prompts").alias("cp"), F.sum("n").alias("cn"), F.sum("cited").alias("cc"))
    lead = F.array_join(F.slice(F.split("cluster", " "), 1, LEAD), " ")
    by_lead = by_cluster.groupBy(lead.alias("lead")).agg(F.sum("cp").alias("lp"), F.sum("cn").alias("ln"), F.sum("cc").alias("lc"))
    judged = clustered.join(by_cluster, "cluster").withColumn("lead", lead).join(by_lead, "lead")
    own = (F.col("cp") >= PROMPTS) & (F.col("cc") <= CITING * F.col("cn"))
    shared = (F.col("lp") >= PROMPTS) & (F.col("lc") <= CITING * F.col("ln"))
    return judged.where(own | shared).select("opening").distinct()


def sample_languages(documents: DataFrame, per_language: int = 300) -> list[tuple[str, str]]:
    """At most about ``per_language`` labelled documents of each language, chosen by hash: a bounded sample."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    d = documents.select(lang.alias("lang"), "text", F.xxhash64("doc_id").alias("h")).where(F.col("lang").isin(*COMMON))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col("lang") == k) & (F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, per_language / n))))
    return [(r["lang"], r["text"] or "") for r in d.where(keep).select("lang", "text").limit(2 * per_language * len(COMMON)).collect()]


def _answer_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A: an answer as masked words, and its last word with the one before it. B: how often a word stands behind another."""
    for b in batches:
        pairs, out = Counter(), []
        for key, texts in zip(b["id"], b["texts"]):
            for own in map(masked_tokens, texts):
                if own:
                    pairs.update(map(" ".join, zip(["^", *own], own)))
                    word = own[-1] if own[-1][0].isalpha() and own[-1] != "X" else None
                    out.append(("A", key, " ".join(own), f"{own[-2] if len(own) > 1 else '^'} {word}" if word else None, 1))
        yield pd.DataFrame([*out, *(("B", None, None, p, n) for p, n in pairs.items())], columns=["kind", "id", "v", "pair", "n"])


def cut_answers(replies: DataFrame) -> DataFrame:
    """``replies`` (id, texts array<string>) to the distinct ids of which some answer was cut: its words nearly always go on elsewhere,
    or its last word only begins one that stands behind the same word. Blank and unlike answers are not cut: nothing tells."""
    kind = dict(replies.dtypes)["id"]
    texts = F.filter("texts", lambda t: t.isNotNull())
    read = materialize(replies.select("id", texts.alias("texts")).mapInPandas(_answer_ends, f"kind string, id {kind}, v string, pair string, n bigint"), "answer-ends")
    answers = read.where("kind = 'A'")
    values = materialize(answers.groupBy("v", "pair").agg(F.count(F.lit(1)).alias("n")), "answers")
    open_ = open_ends(values, values, ANSWERS).select("v", F.lit(None).cast("string").alias("pair"))
    pairs = read.where("kind = 'B'").groupBy("pair").agg(F.sum("n").alias("n"))
    first = F.substring_index("pair", " ", 1)
    longer = pairs.where(F.col("n") >= ANSWERS).select(F.explode(beginnings(F.substring_index("pair", " ", -1))).alias("start"), first.alias("first"), F.col("n").alias("longer"))
    longer = longer.groupBy(F.concat_ws(" ", "first", "start").alias("pair")).agg(F.max("longer").alias("longer"))
    stubs = values.select("pair").where("pair IS NOT NULL").distinct().join(pairs, "pair").join(longer, "pair").where(F.col("n") <= ENDED * F.col("longer")).select("pair")
    cut = values.join(open_.select("v").distinct(), "v", "left_semi").unionByName(values.join(stubs, "pair", "left_semi")).select("v").distinct()
    return salted_join(answers.select("id", "v"), materialize(cut, "cut-answers"), "v", "left_semi").select("id").distinct()


def reply_defects(cells: DataFrame, model: dict) -> DataFrame:
    """(cell_id, defect) of the defective cells; ``cells`` as for ``label_checks``."""
    labelled = materialize(label_checks(cells, model), "checked")
    rest = labelled.where("defect IS NULL AND size(said) > 0")
    templates = refusal_templates(rest.withColumn("opening", opening(F.array_join("said", " "))))
    declined = salted_join(rest.select("cell_id", opening(F.array_join("said", " ")).alias("opening")), templates, "opening", "left_semi").select("cell_id").distinct()
    cut = cut_answers(rest.select(F.col("cell_id").alias("id"), F.col("said").alias("texts"))).withColumnRenamed("id", "cell_id")
    found = declined.withColumn("defect", F.lit("refusal")).unionByName(cut.join(declined, "cell_id", "left_anti").withColumn("defect", F.lit("truncated")))
    return labelled.where("defect IS NOT NULL").select("cell_id", "defect").unionByName(found).distinct()


def result_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model(sample_languages(table(spark, sf_dir, "documents")))
    r = table(spark, sf_dir, "result_cells").select("cell_id", "qid", "text", F.col("answers.answer").alias("answers"), F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence")).where("cell_id IS NOT NULL")
    q = table(spark, sf_dir, "questions").where("qid IS NOT NULL").groupBy("qid").agg(F.max("question").alias("question"), F.coalesce(F.bool_or("not_answerable"), F.lit(False)).alias("not_answerable"))
    return reply_defects(salted_join(r, q, "qid", "left"), model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective cells with their defect."""
    return result_defects(spark, sf_dir)


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects per model and system."""
    cells = table(spark, sf_dir, "result_cells").where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.max("model").alias("model"), F.max("system").alias("system"))
    found = cells.join(result_defects(spark, sf_dir), "cell_id", "left").withColumn("defect", F.coalesce("defect", F.lit("none")))
    return found.groupBy("model", "system", "defect").agg(F.count(F.lit(1)).alias("n_cells"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
ORACLES: dict[str, str] = {}
