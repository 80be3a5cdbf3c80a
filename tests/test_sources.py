"""Stores, manifests, HTML and matching."""
import math

import pytest
from pyspark.sql import functions as F

from quernstone.functions import html
from quernstone.functions import outcomes as O
from quernstone.operators import matching as X
from quernstone.sources import stores as S


def test_json_lines_and_torn_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid": "a", "n": 1}\n{"qid": "b", "n": 2}\n{"qid": "a", "n": 3}\n{"qid": "c", "n"')
    d = S.read_json_lines(spark, str(tmp_path), "qid string, n int")
    assert sorted((r["qid"], r["n"]) for r in S.latest(d, ["qid"], [F.desc("n")]).collect()) == [("a", 3), ("b", 2)]
    good, bad = S.checked_json_lines(spark, str(tmp_path), "qid string, n int")
    assert good.count() == 3 and bad.count() == 1


def test_append_only_what_is_missing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    d = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    S.append_missing(d, path, ["k"], config="one")
    S.append_missing(d.unionByName(spark.createDataFrame([("c", 3)], "k string, v int")), path, ["k"], config="one")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        S.append_missing(d, path, ["k"], config="two")


def test_upsert_and_pairs(spark, tmp_path):
    base, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, S.upsert(base, new, "k").collect())) == [("a", 1), ("b", 9), ("c", 3)]
    (tmp_path / "pairs.txt").write_text("# all\nbank https://a.example/x # note\n\nbank  https://a.example/y\n")
    assert sorted(map(tuple, S.read_pairs(spark, str(tmp_path)).collect())) == [("bank", "https://a.example/x"), ("bank", "https://a.example/y")]


def test_manifest_finds_changes(spark, tmp_path):
    for n, t in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / n).write_text(t)
    then = spark.createDataFrame(S.manifest(spark, str(tmp_path)).collect(), "file string, sha256 string, size bigint")
    (tmp_path / "a").write_text("9")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("4")
    assert sorted(map(tuple, S.mismatches(S.manifest(spark, str(tmp_path)), then).collect())) == [("a", "changed"), ("b", "missing"), ("d", "new")]


def test_html(spark):
    page = "<html><head><title> A  page </title><script>x()</script></head><body><nav>Menu</nav><h1>Fees</h1><p>One&nbsp;fee &amp; <b>more</b></p><main>" + "word " * 100 + "</main></body>"
    r = spark.createDataFrame([(page,), (None,)], "h string").select(html.html_text("h").alias("x"), html.html_main_text("h").alias("m")).collect()
    assert r[0]["x"]["title"] == "A page" and r[0]["x"]["text"].split("\n")[:2] == ["Fees", "One fee & more"] and "Menu" not in r[0]["x"]["text"]
    assert r[0]["m"] == ("word " * 100).strip() and r[1]["x"]["text"] == ""


def test_conditional_scores():
    yes = ("yes", [])
    assert X.conditional_score([yes], [yes]) == (1, 1, 1, 1)
    assert X.conditional_score([("yes", ["c"])], [yes])[2:] == (1.0, 0.0)
    assert X.conditional_score([yes, ("no", [])], [yes])[2] == pytest.approx(math.exp(-1))
    assert X.conditional_score([], [yes]) == (0, 0, 0, 0) and X.conditional_score([], []) == (1, 1, 1, 1)
    assert X.conditional_score([("no", ["d"]), ("yes", ["c"])], [("yes", ["c"]), ("no", ["d"])]) == (1, 1, 1, 1)


def test_outcomes_and_modality(spark):
    m = lambda a, b: spark.range(1).select(X.outcomes_match(F.lit(a), F.lit(b)).alias("v")).first()["v"]
    assert m("the transfer fee is waived", "transfer fee waived") and not m("a fee of 3 applies", "a fee of 5 applies") and not m("the fee is charged", "the fee is not charged") and not m(None, "yes")
    k = lambda a: spark.range(1).select(O.modality(F.lit(a)).alias("v")).first()["v"]
    assert [k(""), k("(per p0)"), k("a fee may apply"), k("you may not always pay"), k("you may not accept it"), k("it depends on you"), k("you are entitled to it")] == ["hedged"] * 4 + ["prohibition", "hedged", "permission"]
    assert [k("you may apply"), k("you may receive a waiver"), k("you must pay"), k("you cannot pay"), k("the fee is 3")] == ["permission", "hedged", "obligation", "prohibition", "statement"]


def test_alignment_is_one_to_one(spark):
    p = spark.createDataFrame([("k", "a", "x", 0.9), ("k", "a", "y", 0.8), ("k", "b", "x", 0.9), ("k", "b", "y", 0.5), ("k", "c", "z", 0.1)], "k string, a string, b string, s double")
    assert sorted((r["a"], r["b"]) for r in X.greedy_alignment(p, "k", "a", "b", "s", 0.25).collect()) == [("a", "x"), ("b", "y")]


def test_common_forms_of_outcomes(spark):
    c = lambda a: spark.range(1).select(O.canonical_outcome(F.lit(a)).alias("v")).first()["v"]
    assert c("Fee is waived (per p0)") == c("no fee applies") == "no fee applies"
    assert c("You are not required to pay twenty-eight pounds") == "is not required to pay 28 pounds"
    assert c("funds of 1,270 held for 28 consecutive days") == "funds of 1270 held for 28 consecutive days" and c("2.50 pounds, 28.0 days, 5.0 per cent") == "2.5 pounds, 28 days, 5%"
    f = lambda a: sorted(spark.range(1).select(O.counted_figures(O.canonical_outcome(F.lit(a))).alias("v")).first()["v"])
    assert f("funds of 1270 held for 28 consecutive days") == ["amount 1270", "day 28"] and f("5% for two years") == ["% 5", "year 2"]
    v = lambda a, b: spark.range(1).select(X.values_match(F.lit(a), F.lit(b)).alias("v")).first()["v"]
    assert v("you must pay", "payment is due") and not v("1270 for 28 days", "1270 for 14 days") and not v("", "") and not v("no fee applies", "a 3% fee applies")


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from quernstone.streaming.events import update_table

    merge = lambda batch, old: (batch if old is None else old.unionByName(batch)).groupBy("k").agg(F.sum("n").alias("n"))
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 10)], [("c", 5), ("b", 1)]]):
        spark.createDataFrame(rows, "k string, n bigint").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("k string, n bigint").parquet(f"file://{tmp_path}/in")
        got = update_table(stream, merge, f"file://{tmp_path}/table")  # each run is a query of its own, started on what the last one left
    assert dict(map(tuple, got.collect())) == {"a": 11, "b": 3, "c": 5}


def test_corpora(spark, tmp_path):
    from quernstone.sources import corpora as C

    (tmp_path / "good.jsonl").write_text('{"id": "a", "text": "x"}\n{"id": "b", "text": "y", "date": "2020"}\n')
    (tmp_path / "twice.jsonl").write_text('{"id": "a", "text": "x"}\n{"id": "a", "text": "y"}\n')
    assert C.corpus_from_json_lines(spark, str(tmp_path / "good.jsonl")).count() == 2
    with pytest.raises(ValueError):
        C.corpus_from_json_lines(spark, str(tmp_path / "twice.jsonl"))
    passage = "array<struct<id:string,text:string,source_type:string,date:string,source_url:string,document_id:string>>"
    records = spark.createDataFrame([("r", [("p0", "first", *[None] * 4), ("p0", "second", *[None] * 4), ("p1", "third", *[None] * 4)])], f"instance_id string, passages {passage}")
    assert sorted((r["id"], r["text"]) for r in C.corpus_from_records(records).collect()) == [("r::p0", "first"), ("r::p1", "third")]
    assert [r["id"] for r in C.corpus_from_texts(spark, ["x", "y"]).orderBy("id").collect()] == ["p0", "p1"]
    C.write_json_lines(C.corpus_from_texts(spark, ["x", "y"]), str(tmp_path / "out"))
    assert C.corpus_from_json_lines(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "q.jsonl").write_text('{"question": "one", "documents": [{"text": "a", "type": "x"}, {"text": "b", "type": "y"}]}\n\n{"question": "two", "documents": [{"text": "c", "type": "x"}]}\n')
    q, d = C.questions_with_documents(spark, str(tmp_path / "q.jsonl"))
    assert sorted((r["qid"], r["question"]) for r in q.collect()) == [("r0", "one"), ("r1", "two")] and sorted(r["doc_id"] for r in d.collect()) == ["r0d0", "r0d1", "r1d0"]


def test_rankings_are_kept(spark, tmp_path):
    from quernstone.sources import corpora as C

    asked = []

    def rank(todo):
        asked.append(sorted(r["qid"] for r in todo.collect()))
        return todo.select("qid", F.lit(1).alias("rank"), F.concat("qid", F.lit("c")).alias("chunk_id"))

    path = f"file://{tmp_path}/ranks"
    q = spark.createDataFrame([("a",), ("b",)], "qid string")
    C.keep_rankings(q, rank, path, "k1")
    got = C.keep_rankings(q.unionByName(spark.createDataFrame([("c",)], "qid string")), rank, path, "k1")
    assert asked == [["a", "b"], ["c"]] and sorted(r["qid"] for r in got.collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        C.keep_rankings(q.unionByName(spark.createDataFrame([("d",)], "qid string")), rank, path, "k2")
    assert C.keep_rankings(q, rank, path, "k2", refresh=True).count() == 2


def test_logs_caches_and_stages(spark, tmp_path):
    from quernstone.sources import corpora as C

    (tmp_path / "log.jsonl").write_text('{"kind": "k", "annotator": "a", "item": "i", "decision": "no", "seconds": 1800, "at": "1"}\n{"kind": "k", "annotator": "a", "item": "i", "decision": "yes", "seconds": 1800, "at": "2"}\n{"kind": "k"')
    stands, hours = C.reviews(spark, str(tmp_path / "log.jsonl"))
    assert [r["decision"] for r in stands.collect()] == ["yes"] and [(r["hours"], r["n_lines"]) for r in hours.collect()] == [(1.0, 2)]
    assert C.sealed(stands, spark.createDataFrame([("a", "1")], "annotator string, sealed_at string")).count() == 1
    cache = spark.createDataFrame([("x", "m", "old", 1), ("y", "n", "r", 1)], "key string, model string, response string, at int")
    put = C.cache_put(cache, spark.createDataFrame([("x", "m", "new", 2), ("x", "m", "newer", 3)], cache.schema))
    assert sorted((r["key"], r["response"]) for r in put.collect()) == [("x", "newer"), ("y", "r")] and [r["key"] for r in C.cache_clear(put, "m").collect()] == ["y"] and C.cache_clear(put).count() == 0
    e = spark.createDataFrame([("r", i, s, t) for i, (s, t) in enumerate([("read", 0), ("read", 2), ("rank", 5), ("say", 9)])] + [("o", 0, "read", 0)], "run_id string, seq int, stage string, t int").withColumn("at", F.timestamp_seconds("t"))
    assert [r["seq"] for r in C.events_after(e, "r", 1).collect()] == [2, 3]
    assert {(r["run_id"], r["stage"]): r["seconds"] for r in C.stage_durations(e).collect()} == {("r", "read"): 5.0, ("r", "rank"): 4.0, ("r", "say"): None, ("o", "read"): None}


def test_pairs_and_releases(spark, tmp_path):
    from quernstone.sources import corpora as C

    pairs = spark.createDataFrame([("bank", "u2"), ("bank", "u1"), ("bank", "u3"), ("city", "u1")], "provider string, url string")
    C.write_pairs(pairs, str(tmp_path / "pairs"))
    back = S.read_pairs(spark, str(tmp_path / "pairs"))
    assert sorted(map(tuple, C.existing_pairs(back).collect())) == [("u1", "u2"), ("u1", "u3"), ("u2", "u3")]
    made = C.write_release({"pairs": pairs.coalesce(1), "urls": pairs.select("url").distinct().coalesce(1)}, f"file://{tmp_path}/release")
    assert {r["table"] for r in made.collect()} == {"pairs", "urls"} and C.broken_files(spark, f"file://{tmp_path}/release").count() == 0
    next((tmp_path / "release" / "urls").glob("part*.json")).write_text("changed")
    for crc in (tmp_path / "release" / "urls").glob(".*.crc"):
        crc.unlink()
    assert [(r["table"], r["status"]) for r in C.broken_files(spark, f"file://{tmp_path}/release").collect()] == [("urls", "changed")]
    assert [r["json"] for r in C.short_keys(pairs.limit(1), {"provider": "p", "url": "u"}).collect()] == ['{"p":"bank","u":"u2"}'] and '"name": "url"' in C.json_contract(pairs)
