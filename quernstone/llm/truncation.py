"""Text cut off by field limits, found by a self-join by prefix.

A text is cut into units: lines, and sentences inside paragraphs (wrapped lines are joined first). Whole texts have no longer copy
elsewhere, but their last unit has: names and numbers are masked, and the last unit, and its last words, are joined by hash with
all units that go on behind the same words (``endings``). A last unit whose words nearly always go on was cut off. The same
self-join on single words finds a last word that begins a longer spoken word and occurs nowhere else. Marks of omission are read
as they stand.

Defined results: null and blank texts are not cut; repeated rows count once; a doc_id delivered with several texts is cut if one
of them is; a last unit like no other is not cut, as nothing tells; empty tables give empty results; texts may be of any length.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.endings import beginnings, masked_tokens, open_ends
from quernstone.plans.materialize import discard, materialize
from quernstone.plans.skew import salted_join
from quernstone.sources.tables import table

#: Words of a last unit are evidence once they stand so often elsewhere; behind a name, with so many other words.
SEEN, NAME_WORDS = 10, 2

OMISSION = r"(\.\.\.+|…|\[(…|\.\.\.+)\]|\((…|\.\.\.+)\)|\[?\b(truncated|cut off)\]?)\s*$"
CLOSED = r"[.!?][\"'”’)\]*]*$"

UPPER = "".join(c for c in map(chr, range(0x530)) if c.isupper())
LOWER = "".join(c for c in map(chr, range(0x530)) if c.islower())
_WRAP = re.compile(rf"[ \t]*\n(?:> ?)?(?=[{LOWER}£€$\d])(?!\d{{1,2}} [{UPPER}]\w+ \d+(?:\n|$))")
_STOP = re.compile(rf"[.!?][\"”’)]*\s+(?=[{UPPER}“\"(])")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")
_LAST_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*$")
_OMISSION, _CLOSED = re.compile(OMISSION, re.I), re.compile(CLOSED)


def units(text: str) -> list[str]:
    """The units of a text, in order: lines, and the sentences of paragraphs."""
    out = []
    for line in _WRAP.sub(" ", text.strip()).split("\n"):
        at = 0
        for m in _STOP.finditer(line):
            out.append(line[at : m.end()].strip())
            at = m.end()
        out.append(line[at:].strip())
    return [u for u in out if u]


EXTRACT = "kind string, doc_id {}, source string, omitted boolean, closed boolean, v string, word string, n bigint"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch: the last units (L), how often each masked unit stands before others (V), and each word (W)."""
    for b in batches:
        last, values, words = [], Counter(), Counter()
        for doc_id, source, text in zip(b["doc_id"], b["source"], b["text"]):
            own = units(text) if text else []
            if not own:
                continue
            tail = _OMISSION.sub("", own[-1]).strip()
            word = _LAST_WORD.search(tail)
            last.append(("L", doc_id, source, bool(_OMISSION.search(text)), bool(_CLOSED.search(own[-1])), " ".join(masked_tokens(tail)), word[0] if word else "", 1))
            values.update(own[:-1])
            words.update(set(_WORD.findall("\n".join(own[:-1]))))
        masked = Counter()
        for v, n in values.items():
            masked[" ".join(masked_tokens(v))] += n
        last += [("V", None, None, None, None, v, None, n) for v, n in masked.items()]
        last += [("W", None, None, None, None, None, w, n) for w, n in words.items()]
        yield pd.DataFrame(last, columns=["kind", "doc_id", "source", "omitted", "closed", "v", "word", "n"])


def cut_texts(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, source, text) to (doc_id, source, cut, reason)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    d = documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    read = materialize(d.mapInPandas(_extract, EXTRACT.format(kind)), "units")
    last = read.where("kind = 'L'").drop("kind", "n")
    unclosed = last.where("NOT omitted AND NOT closed")
    values = materialize(read.where("kind = 'V' OR (kind = 'L' AND NOT omitted)").groupBy("v").agg(F.sum("n").alias("n")), "values")
    begins = open_ends(values, unclosed.select("v"), SEEN, NAME_WORDS).withColumn("begins", F.lit(True))
    discard(values)

    asked = unclosed.where("word <> ''").select("word").distinct()
    spoken = read.where("kind = 'W'").groupBy("word").agg(F.sum("n").alias("n"))
    longer = spoken.select(F.explode(beginnings(F.col("word"))).alias("word")).distinct()
    stub = asked.join(spoken, "word", "left_anti").join(longer, "word", "left_semi").withColumn("stub", F.lit(True))

    x = salted_join(salted_join(last, begins, "v", "left"), stub, "word", "left")
    reason = F.when(F.col("omitted"), "omission").when(F.col("closed"), F.lit(None).cast("string")).when(F.col("stub"), "word").when(F.col("begins"), "prefix")
    return x.select("doc_id", "source", reason.isNotNull().alias("cut"), reason.alias("reason"))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found cut, with the reason."""
    return cut_texts(table(spark, sf_dir, "documents")).where("cut").groupBy("doc_id").agg(F.min("reason").alias("reason"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is broken off."""
    return cut_texts(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    docs = table(spark, sf_dir, "documents")
    cut = cut_texts(docs).where("cut").groupBy("source").agg(F.count_distinct("doc_id").alias("n_cut"))
    every = docs.where("doc_id IS NOT NULL").groupBy("source").agg(F.count_distinct("doc_id").alias("n_documents"))
    same = every["source"].eqNullSafe(cut["source"])
    return every.join(cut, same, "left").select(every["source"], "n_documents", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_documents")).alias("rate"))


QUERIES = {"p8_found": p8_found, "p8_documents": p8_documents, "p8_rates": p8_rates}
ORACLES: dict[str, str] = {}
