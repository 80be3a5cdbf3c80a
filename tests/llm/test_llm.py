"""The operators for training data: hand-checked cases, dirt and brute force."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.llm import consensus, cross_split, endings, grouped_splits, leakage, mixing, reply_defects, split_boundaries, truncation


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


# 1 ------------------------------------------------------------------------------------------------------------------------

RECORD = "id string, keys array<string>, split string, component string, n string"


def test_groups_conflicts_and_new_records(spark, tmp_path):
    data = [
        ("q1", ["doc|1", "asker|a"], "train", "x", None), ("q1", ["doc|1", "asker|a"], "train", "x", None), ("q2", ["doc|2", "asker|a"], "test", None, None), ("q3", ["doc|2", None], None, None, None),
        ("q4", ["doc|3", None], "dev", None, None), ("q5", [None, None], "train", None, None), ("q6", None, "odd", None, None), (None, ["doc|3", "asker|z"], "dev", None, None), ("q7", ["doc|9", "asker|z"], None, None, None),
    ]
    links = spark.createDataFrame([("doc|4", "page|p"), ("doc|5", None)], "a string, b string")
    store = f"file://{tmp_path}/store"
    got = {r["id"]: r for r in grouped_splits.update_components(spark.createDataFrame(data, RECORD), links, store=store).collect()}
    assert set(got) == {f"q{i}" for i in range(1, 8)}
    assert {k for k, r in got.items() if r["quarantined"]} == {"q1", "q2", "q3"}
    assert got["q1"]["component"] == got["q3"]["component"] and got["q4"]["component"] == got["q7"]["component"]
    assert got["q4"]["split"] == got["q7"]["split"] == "dev" and got["q5"]["split"] == "train"
    assert all(r["quarantined"] == (r["split"] is None) for r in got.values()) and all(r["split"] in grouped_splits.RATIOS for r in got.values() if r["split"])
    # a later run: q8 joins q4's component through the store and takes its split; nothing stored moves
    later = grouped_splits.update_components(spark.createDataFrame([("q8", ["asker|z"], None, None, None)], RECORD), links.limit(0), store=store).collect()
    assert [(r["id"], r["split"], r["quarantined"], r["n_component"]) for r in later] == [("q8", "dev", False, 3)]
    # a new record of a quarantined component is quarantined; q1 delivered again is no further record
    more = [("q9", ["asker|a"], None, None, None), ("q1", ["doc|1"], "train", None, None)]
    later = grouped_splits.update_components(spark.createDataFrame(more, RECORD), links.limit(0), store=store).collect()
    assert sorted((r["id"], r["split"], r["quarantined"], r["n_component"]) for r in later) == [("q1", None, True, 4), ("q9", None, True, 4)]
    # a merge of two stored components with different splits is quarantined, and so is what comes after
    for batch in ([("q10", ["asker|z", "asker|b5"], None, None, None), ("q11", ["asker|b5"], "train", None, None)], [("q12", ["doc|9"], None, None, None)]):
        later = grouped_splits.update_components(spark.createDataFrame(batch, RECORD), links.limit(0), store=store).collect()
        assert all(r["quarantined"] and r["split"] is None for r in later)
    kept = {r["id"]: r for r in grouped_splits.stored_splits(spark, store).collect()}
    assert set(kept) == {f"q{i}" for i in range(1, 13)} and {k for k, r in kept.items() if r["quarantined"]} == {"q1", "q2", "q3", "q4", "q7", "q8", "q9", "q10", "q11", "q12"}
    assert kept["q4"]["component"] == kept["q11"]["component"] and kept["q4"]["n_component"] == 6 and kept["q5"]["split"] == "train"


def test_deficits_are_those_of_all_that_is_stored(spark, tmp_path):
    none = spark.createDataFrame([], "a string, b string")
    store = f"file://{tmp_path}/store"
    for lo, split in ((0, "train"), (600, None)):
        data = [(f"q{i}", [f"doc|{i}"], split, None, None) for i in range(lo, lo + 600 - lo // 3)]
        grouped_splits.update_components(spark.createDataFrame(data, RECORD), none, store=store).count()
    got = {r["split"]: r["count"] / 1000 for r in grouped_splits.stored_splits(spark, store).groupBy("split").count().collect()}
    assert got == pytest.approx(grouped_splits.RATIOS, abs=0.03)


def test_shares_follow_the_ratios(spark):
    data = [(f"q{i}", [f"doc|{i // 3}"], None, None, None) for i in range(1500)]
    got = grouped_splits.update_components(spark.createDataFrame(data, RECORD), spark.createDataFrame([], "a string, b string")).groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 1500 for r in got}
    assert share == pytest.approx(grouped_splits.RATIOS, abs=0.03)


def test_no_records(spark):
    assert grouped_splits.update_components(spark.createDataFrame([], RECORD), spark.createDataFrame([], "a string, b string")).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------------

MODEL = reply_defects.language_model([])
QUESTION = "How much of the Garden Grant do I get when I run a market stall?"


@pytest.mark.parametrize(
    "text, answers, na, defect",
    [
        (None, [], False, "empty"), (None, [], True, None), ("   \n", [], False, "empty"), ('{"answers": []}', [], False, "empty"), ('{"answers": [{"answer": "n/a"}]}', ["n/a"], False, "empty"),
        ('{"answers": [{"answer": "up to 5', [], False, "truncated"), ('```json\n{"answers": [{"answer": "up', ["up"], True, "truncated"), ("[truncated] finish_reason=length after 256 tokens", [], False, "truncated"),
        ('{"answers": [{"answer": "a } in \\" text", "conditions": [],}]}', ["a } in \" text"], False, None), ('Here it is.\n{"answers": [{"answer": "yes"}]}\nDone', ["yes"], False, None),
        (QUESTION, [], False, "copies_question"), (QUESTION.upper(), [], False, "copies_question"), ("x", ["You asked: " + QUESTION], False, "copies_question"), ("x", ["much of the Garden Grant do I get when I run a market stall"], False, "copies_question"),
        ("x", ["you get the Garden Grant when you run a market stall, for up to 60 weeks"], False, None),
        ("oui, c'est possible", [], False, "other_language"), ("x", ["nie, to nie jest dozwolone"], False, "other_language"), ("x", ["no"], False, None), ("x", ["£567, then £2,048"], False, None),
    ],
)
def test_reply_checks(text, answers, na, defect):
    assert reply_defects.checks(text, answers, QUESTION, na, MODEL, {})[0] == defect


def test_templates_reveal_refusals(spark):
    cells = "cell_id int, text string, answers array<string>, n_evidence int, question string, not_answerable boolean, defect string, opening string"
    data = [(i, "The desk is closed to such matters, ask elsewhere please", [], 0, f"Can I claim the grant number {i}?", False, "x", None) for i in range(6)]
    data += [(10 + i, "x", ["the higher rate applies to such matters in this case"], 2, f"Can I claim the bond number {i}?", False, None, None) for i in range(6)]
    data += [(20, "Sorry, I am unable to discuss this topic", [], 0, "Can I claim it?", False, None, None), (20, "Sorry, I am unable to discuss this topic", [], 0, "Can I claim it?", False, None, None), (21, None, None, 0, None, None, None, None), (22, "a " * 50_000 + "word", [], 0, None, False, None, None)]
    d = spark.createDataFrame(data, cells).withColumn("not_answerable", F.coalesce("not_answerable", F.lit(False)))
    got = dict(rows(reply_defects.reply_defects(d, MODEL), "cell_id", "defect"))
    assert got == {**{i: "refusal" for i in range(6)}, 21: "empty"}  # one prompt alone makes no template
    assert reply_defects.reply_defects(d.limit(0), MODEL).count() == 0


def test_reworded_templates_are_one(spark):
    said = "we keep to other {} matters than such a case at desk".format
    data = [(said(w), k, False) for k, w in enumerate(["today", "now", "always"])]
    data += [("the higher rate of the {} is paid to people with a home".format(w), k, True) for k, w in enumerate(["levy", "bond", "grant"])]
    # other openings that share the lead, and cite
    data += [(f"we keep to the rate {k} of a different page number altogether {k}", 10 + k, True) for k in range(9)]
    got = reply_defects.refusal_templates(spark.createDataFrame(data, "opening string, prompt bigint, cites boolean"))
    assert rows(got, "opening") == sorted((said(w),) for w in ["today", "now", "always"])


def test_openings_link_as_by_brute_force(spark):
    rng = random.Random(9)
    texts = set()
    for _ in range(25):
        base = rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 12))
        for _ in range(12):
            w = [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") if rng.random() < 0.1 else x for x in base if rng.random() > 0.06] or base
            texts.add(" ".join(w))
    sets = {t: set(t.split()) for t in texts}
    top = {t: t for t in texts}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    brute = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    data = spark.createDataFrame([(t,) for t in texts], "opening string").withColumn("sh", F.array_distinct(F.transform(F.split("opening", " "), lambda w: F.xxhash64(w))))
    links = {tuple(sorted(p)) for p in rows(reply_defects.similar_openings(data), "a", "b")}
    assert links <= brute and len(brute) > 100
    for a, b in links:
        top[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in brute)


def test_refusal_behind_a_long_preamble(spark):
    cells = "cell_id int, text string, answers array<string>, n_evidence int, question string, not_answerable boolean"
    said = "The rules of the grant are many and the office has them. " * 12 + "I cannot answer this question."
    d = spark.createDataFrame([(i, said, [], 0, f"Can I claim the grant {i}?", False) for i in range(3)], cells)
    assert rows(reply_defects.reply_defects(d, MODEL), "cell_id", "defect") == [(i, "refusal") for i in range(3)]


def test_answers_cut_inside_a_whole_reply(spark):
    cells = "cell_id int, text string, answers array<string>, n_evidence int, question string, not_answerable boolean"
    whole = "the higher rate is paid for {} weeks after the birth of the child".format
    said = {i: [whole(i + 5)] for i in range(40)}
    said |= {50: ["the higher rate is paid for 12 weeks after the"], 51: ["the higher rate is paid for 12 weeks after the birth of the chi"], 52: ["yes", "the higher rate is pa"], 53: ["the higher rate"], 54: ["yes"], 55: ["it is unlike all others"], 56: [None, ""]}
    d = spark.createDataFrame([(i, "x", a, 1, None, False) for i, a in said.items()] + [(50, "x", said[50], 1, None, False)], cells)
    got = rows(reply_defects.reply_defects(d, MODEL).where("defect = 'truncated'"), "cell_id")
    assert got == [(50,), (51,), (52,), (53,)]


# 3 ------------------------------------------------------------------------------------------------------------------------

TEXT = "Interest of 38 per cent is added 22 months after the end of the tax year and the bank clerk splits the share before any money is paid out to the lodger"
OTHER = "Travel to Yarbury for more than 39 days ends the levy unless you have nine children at school and the panel weighs each missed lesson at the counter"


def test_same_records_across_splits(spark):
    data = [
        ("a", "train", "Can I claim the Early Account now?", [TEXT, OTHER], "h"), ("a", "train", "Can I claim the Early Account now?", [TEXT, OTHER], "h"),
        ("b", " TEST", "can i claim the early account, now", [OTHER.upper() + ".", "  " + TEXT], None),  # the same but for case, stops and order
        ("c", "dev", "Can I claim the Erly Account now?", [TEXT.replace("22", "23").replace("clerk", "clerc"), OTHER + " Updated this month."], None),  # nearly
        ("d", "dev", "Is a printer allowed to hold it?", [TEXT], None),  # one passage only
        ("e", "test", "Can I claim the Early Account now?", ["Something else entirely stands in this passage about harbour fees and boats"], None),  # the query only
        ("f", "train", None, None, None), ("g", "test", None, [None, ""], None), ("h", None, "Can I claim the Early Account now?", [TEXT, OTHER], None), (None, "test", "Can I claim the Early Account now?", [TEXT, OTHER], None),
    ]
    d = spark.createDataFrame(data, "id string, split string, query string, passages array<string>, h string")
    assert rows(cross_split.cross_split_pairs(d), "train_id", "eval_id", "exact") == [("a", "b", True), ("a", "c", False)]
    assert cross_split.cross_split_pairs(d.limit(0)).count() == 0


def test_stock_passages_fall_apart_by_query(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(120):  # every record has the stock passage; some queries are reworded copies
        base = rng.sample(words, 8)
        for split in ("train", "dev"):
            q = [w if rng.random() > 0.15 else rng.choice(words) for w in base] if i % 3 == 0 else rng.sample(words, rng.randint(3, 9))
            data.append((f"{split}{i:03}", split, " ".join(q), [TEXT]))
    data += [("trainblank", "train", None, [TEXT]), ("devblank", "dev", "", [TEXT + " today"])]
    overlap = lambda a, b: sum((Counter(a) & Counter(b)).values()) / max(1, len(a), len(b))
    own = lambda q: (q or "").split()
    brute = {(a[0], b[0]) for a in data for b in data if a[1] == "train" and b[1] == "dev" and (not own(a[2]) and not own(b[2]) or overlap(own(a[2]), own(b[2])) >= cross_split.SAME_QUERY)}
    d = spark.createDataFrame(data, "id string, split string, query string, passages array<string>")
    for many in (1, 256):
        monkeypatch.setattr(cross_split, "MANY", many)
        got = set(rows(cross_split.cross_split_pairs(d), "train_id", "eval_id"))
        assert got == brute and len(brute) > 20


# 4 ------------------------------------------------------------------------------------------------------------------------


def test_pieces_fit_and_cover():
    rng = random.Random(3)
    for _ in range(200):
        elements = [" ".join("w" + rng.choice(["", "", "", ",", ".", ".”"]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))] + [None]
        limit, overlap = rng.randint(1, 40), rng.randint(0, 45)
        words = [w for e in elements for w in (e or "").split()]
        got = split_boundaries.pieces(elements, limit, overlap)
        assert bool(got) == (len(words) > limit)
        at = 0
        for p in got:
            assert p["word_end"] - p["word_start"] <= limit and p["text"].split() == words[p["word_start"] : p["word_end"]]
            assert p["word_start"] + p["n_overlap"] == at and (p["n_overlap"] == min(overlap, limit - 1, at))
            at = p["word_end"]
        assert not got or at == len(words)


def test_cuts_at_the_strongest_boundary():
    text = "one two three four. five six seven, eight nine ten"
    assert [p["text"] for p in split_boundaries.pieces([text], 6, 0)] == ["one two three four.", "five six seven, eight nine ten"]
    assert split_boundaries.pieces(["one two three four", "five six seven. eight"], 5, 0)[1]["cut_at"] == "element"
    # texts come as stored
    stored = ["one  two\u00a0three.", "\tfour\n five "]
    cut = [p["text"] for p in split_boundaries.pieces(stored, 4, 1)]
    assert all(t in "\n".join(stored) for t in cut) and any("two\u00a0three." in t for t in cut) and cut[-1].endswith("four\n five")
    assert split_boundaries.pieces(["w"] * 1 + ["x " * 100_000], 50, 5)[-1]["word_end"] == 100_001


def test_oversized_items_with_dirt(spark):
    d = spark.createDataFrame([("a", ["x y z", None], 2, 1, 9), ("a", ["x y z", None], 2, 1, 9), ("b", None, 2, 1, 9), ("c", ["x y z"], None, 1, 9), ("d", [], 0, None, 9), ("e", ["x y"], 1, None, 9)], "id string, elements array<string>, max_words int, overlap_words int, piece int")
    assert set(rows(split_boundaries.split_oversized(d), "id", "text")) == {("a", "x"), ("a", "x y"), ("a", "y z"), ("e", "x"), ("e", "y")}
    assert split_boundaries.split_oversized(d.limit(0)).count() == 0
    assert spark.range(1).select(split_boundaries.n_words(F.lit(" a b\n| c "))).first()[0] == 4


# 5 ------------------------------------------------------------------------------------------------------------------------

PASS = "instance_id string, annotator string, conflict_type string, scope_relation string, labelled_at string, posterior string"


def test_latest_label_and_spellings(spark):
    data = [("i", "a", "Conditional ", "refinement", "2025-01-01T10:00:00+01:00", "x"), ("i", "a", "no conflict", None, "2025-01-01T09:30:00Z", None), ("i", "a", "no conflict", None, "2025-01-01T09:30:00Z", None), ("i", "b", "conditional", None, "2025-01-01T09:30:00Z", None),
            ("i", "c", "nonsense", None, "2025-01-01T09:30:00Z", None), (None, "c", "factual", None, "2025-01-01T09:30:00Z", None), ("i", None, "factual", None, "2025-01-01T09:30:00Z", None), ("i", "d", "factual", None, "soon", None)]
    assert rows(consensus.ballots(spark.createDataFrame(data, PASS)), "annotator", "label") == [("a", 0), ("b", consensus.OPEN)]


def test_consensus_against_planted_truth(spark):
    rng = random.Random(4)
    skill = {f"good{i}": 0.9 for i in range(4)} | {f"bad{i}": 0.3 for i in range(5)}
    truth, data = {}, []
    for i in range(400):
        truth[f"i{i}"] = t = rng.choice(consensus.CLASSES)
        for who in rng.sample(sorted(skill), 5):
            c, s = t if rng.random() < skill[who] else rng.choice(consensus.CLASSES)
            data.append((f"i{i}", who, c, s if c == "conditional" and rng.random() < 0.9 else None, "2025-01-01T09:30:00Z", None))
    votes = consensus.ballots(spark.createDataFrame(data, PASS))
    items, people = consensus.minimax_entropy(votes, rounds=6)
    got = {r["instance_id"]: (r["conflict_type"], r["scope_relation"]) for r in consensus.decided(items).collect()}
    count = {}
    for i, _, c, s, *_ in data:
        count.setdefault(i, []).append((c, s or "none"))
    plurality = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in count.items()) / 400
    right = sum(got[i] == t for i, t in truth.items()) / 400
    assert right >= plurality and right > 0.75
    rel = {r["annotator"]: r["reliability"] for r in people.collect()}
    assert min(v for k, v in rel.items() if k.startswith("good")) > max(v for k, v in rel.items() if k.startswith("bad"))


def test_agreement_over_all_items(spark):
    # a published example of nominal alpha: four coders, twelve units, missing labels
    coders = ["1 2 3 3 2 1 4 1 2 - - -", "1 2 3 3 2 2 4 1 2 5 - 3", "- 3 3 3 2 3 4 2 2 5 1 -", "1 2 3 3 2 4 4 1 2 5 1 -"]
    data = [(u, v) for c in coders for u, v in enumerate(c.split()) if v != "-"]
    r = consensus.krippendorff(spark.createDataFrame(data, "item int, v string"), "item", "v", "x").first()
    assert r["alpha"] == pytest.approx(0.743, abs=1e-3) and (r["n_items"], r["n_labels"]) == (11, 40)
    one = consensus.krippendorff(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "item int, v string"), "item", "v", "x").first()
    assert one["alpha"] is None and one["observed"] == 1.0


def test_open_scopes_agree_with_any(spark):
    data = [("i", who, "conditional", s, "2025-01-01T10:00:00Z", None) for who, s in (("a", "refinement"), ("b", None), ("c", "opposed"))]
    items, _ = consensus.minimax_entropy(consensus.ballots(spark.createDataFrame(data, PASS)), rounds=3)
    assert items.first()["agreement"] == pytest.approx(4 / 6)


def test_consensus_of_nothing(spark):
    items, people = consensus.minimax_entropy(consensus.ballots(spark.createDataFrame([], PASS)))
    assert consensus.decided(items).count() == 0 and people.count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(48, 120))), "k") for i in range(12)] + [(90, None, "k"), (91, "", "k"), (92, "w1 w2", "k"), (0, None, "k")]
    docs, expected = [], set()
    for d in range(120):
        body = prose(rng.randint(0, 150))
        if d % 3 == 0:
            i = rng.randrange(12)
            w = items[i][1].split()
            part = rng.choice([1.0, 0.7, 0.3])
            n = int(part * len(w))
            s = rng.randint(0, len(w) - n)
            held = [x if rng.random() > 0.05 else "typo" for x in w[s : s + n]]
            at = rng.randint(0, len(body))
            body[at:at] = held
            if part > 0.5:
                expected.add((i, d))
        text = " ".join(body)
        docs.append((d, text.replace(" ", "\n> ", 3).upper() if d % 2 else text, 1.0))
    docs += [(500, None, 1.0), (501, "", 1.0), (None, items[0][1], 1.0), (docs[0][0], docs[0][1], 1.0), (502, "x " * 60_000, 1.0)]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id int, text string, held double"), spark.createDataFrame(items, "item_id int, text string, doc_id string"))
    found = set(rows(got, "item_id", "doc_id"))
    assert expected <= found and {p for p in found - expected if p[0] != 92} == set()
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert leakage.find_leaks(empty, spark.createDataFrame(items, "item_id int, text string, doc_id string")).count() == 0
    assert leakage.find_leaks(spark.createDataFrame(docs, "doc_id int, text string, held double"), spark.createDataFrame([], "item_id int, text string")).count() == 0


def test_stock_sentences_hide_no_true_copy():
    item = [f"w{i}" for i in range(60)]
    stock, rest = item[:22], [w if k % 5 else "altered" for k, w in enumerate(item[22:56], 1)]
    doc = stock + ["x"] * 40 + stock + ["y"] * 90 + rest + ["z"] * 70 + stock
    where = {}
    for j, g in enumerate(zip(doc, doc[1:])):
        where.setdefault(g, []).append(j)
    assert leakage.held_stretch(item, doc, where) >= leakage.HELD


def test_altered_halves_pass_the_filters(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(rng.randint(60, 120))) for i in range(10)]
    docs = []
    for d in range(80):
        w, body = items[d % 10][1], prose(rng.randint(20, 150))
        n = -(-len(w) // 2) + 3
        s = rng.randint(0, len(w) - n)
        body[20:20] = [x if k % 4 else "altered" for k, x in enumerate(w[s : s + n], 1)] if d < 40 else []
        docs.append((d, body))
    brute = set()
    for d, w in docs:
        where = {}
        for j, g in enumerate(zip(w, w[1:])):
            where.setdefault(g, []).append(j)
        brute |= {(i, d) for i, own in items if leakage.held_stretch(own, w, where) >= leakage.HELD}
    known = leakage.Terms()
    runs = leakage.Runs([leakage.term_ids(w, known) for _, w in items])
    kept = runs.possible([leakage.term_ids(w, known) for _, w in docs], leakage.np.arange(len(docs) * len(items)))
    assert brute <= {(int(p) % 10, int(p) // 10) for p in kept} and len(kept) < 2 * len(brute) and len(brute) >= 36
    frame = lambda x, names: spark.createDataFrame([(k, " ".join(w)) for k, w in x], names)
    assert set(rows(leakage.find_leaks(frame(docs, "doc_id int, text string"), frame(items, "item_id int, text string")), "item_id", "doc_id")) == brute


def test_common_subsequence_against_table():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leakage.common_subsequence(a, b) == t[-1][-1]


# 7 ------------------------------------------------------------------------------------------------------------------------


def test_mix_reaches_its_shares(spark):
    data = [(i, "abc"[i % 3] if i % 10 else None, 50 + (i * 37) % 400) for i in range(3000)]
    sizes = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.2, 1, "x"), ("b", 0.6, 3, "x"), ("c", 0.15, 1, "x"), ("none", 0.05, 2, "x"), (None, 0.5, 1, "x")], "source string, target_share double, max_repeats int, copies string")
    plan = mixing.allocate(sizes, targets)
    got = mixing.mix(sizes, plan)
    total = sum(n for *_, n in data)
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"), F.max("copies").alias("most")).collect()}
    short = {r["source"]: r["short"] for r in plan.collect()}
    assert short == {"a": False, "b": False, "c": False, "none": True}
    for s, share, most in (("a", 0.2, 1), ("b", 0.6, 3), ("c", 0.15, 1)):
        assert by[s]["n"] / total == pytest.approx(share, abs=0.001) and by[s]["most"] <= most
    assert got.select("doc_id").distinct().count() == got.count()


def test_mix_of_nothing_and_tokens(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.allocate(empty, targets)
    assert rows(plan, "source", "short") == [("a", True)] and mixing.mix(empty, plan).count() == 0
    d = spark.createDataFrame([(1, "a", "Hello world", 5), (2, "a", None, 5), (3, None, "", 5)], "doc_id int, source string, text string, n_tokens int")
    assert rows(mixing.count_tokens(d), "doc_id", "n_tokens") == [(1, 2), (2, 0), (3, 0)]


def test_found_sources_come_from_the_mix(spark, monkeypatch):
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda sizes, plan: mix(sizes, plan).withColumn("copies", F.raise_error(F.lit("sampled")).cast("int")))
    with pytest.raises(Exception, match="sampled"):
        mixing.p7_found(spark, "/root/testdata/sf0.001").collect()


# 8 ------------------------------------------------------------------------------------------------------------------------


def test_cut_texts(spark):
    whole = ["You must apply to the office within 5 days of the letter. Fees are £20 for adults.", "You can ask if you:\n- own a share of a farm\n- the decision letter", "| baker | Elton | £20 |\n| cook | Elton | £30 |", "All is well here.\n\nBest wishes\nElton Mutual", "All is well here.\n\nContact: Elton Desk, room 7", "All is well here.\n\n4 February 2024", "All is well here.\n\n* * *", "All is well here. (Checked by Elton.)", "All is well here.\n\n[end of notes]", None, "", "   "]
    cut = ["All is well here. You must apply to the office within", "All is well here. Fees are £20 for adu", "You can ask if you:\n- own a share of a farm\n- the decis", "| baker | Elton | £20 |\n| cook | Elt", "All is well here. Fees are £20…", "All is well here. Fees are £20 ...", "Fees are £20 for adults. If you own a share of a farm the rate falls by", "word " * 30_000 + "and then the"]
    # what is whole stands elsewhere too, and goes on there or ends: else nothing could tell
    more = ["You can ask if you:\n- own a share of a farm\n- the decision letter\n- the hearing", "If you own a share of a farm the rate falls by £30 and then the fee. All is well here.", *[t for t in whole if t]] * 12
    data = [(i, "s", t, True) for i, t in enumerate(whole + more)] + [(1000 + i, None, t, True) for i, t in enumerate(cut)] + [(1000, None, cut[0], True)]
    d = spark.createDataFrame(data, "doc_id int, source string, text string, cut boolean")
    got = truncation.cut_texts(d)
    assert sorted({r["doc_id"] for r in got.where("cut").collect()}) == [1000 + i for i in range(len(cut))]
    assert truncation.cut_texts(d.limit(0)).count() == 0


def test_cut_values_hide_no_longer_copies(spark):
    base = "You can ask if you:\n- keep the signed application form\n- ask twice"
    cut = ["You can ask if you:\n- keep the signed appli", "You can ask if you:\n- keep the signed applic", "You can ask if you:\n- keep the", "You can ask if you:\n- keep the signed"]
    data = [(i, "s", base) for i in range(20)] + [(100 + i, "s", t) for i, t in enumerate(cut)]
    found = truncation.cut_texts(spark.createDataFrame(data, "doc_id int, source string, text string"))
    assert dict(rows(found.where("cut"), "doc_id", "reason")) == {100: "word", 101: "word", 102: "prefix", 103: "prefix"}


def test_open_ends_as_by_brute_force(spark):
    rng = random.Random(4)
    values = Counter(" ".join(rng.choice("abcX9") for _ in range(rng.randint(1, 12))) for _ in range(6000))
    for seen, others in ((3, 0), (10, 2)):
        on, end = Counter(), Counter()

        def keys(t, i):
            return [("^", *t[:i]), *(tuple(t[i - k : i]) for k in endings.LENGTHS if k <= i)]

        for v, n in values.items():
            t = v.split()
            for i in range(1, len(t) + 1):
                for key in keys(t, i):
                    (end if i == len(t) else on)[key] += n
        brute = set()
        for v in values:
            t = v.split()
            masked = others and t[-1] in "X9"
            for key in keys(t, len(t)):
                if masked and sum(w not in "X9^" for w in key) < others:
                    continue
                if on[key] + end[key] > seen:
                    if on[key] and end[key] - 1 <= (endings.NAMES_ENDED if masked else endings.ENDED) * on[key]:
                        brute.add(v)
                    break
        frame = spark.createDataFrame(list(values.items()), "v string, n bigint")
        assert {r["v"] for r in endings.open_ends(frame, frame, seen, others).collect()} == brute and brute


# the catalogue ----------------------------------------------------------------------------------------------------------------


def test_catalogue_has_every_problem():
    from quernstone.llm import catalogue

    assert {f"p{i}_found" for i in range(1, 9)} <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["p1_found", "p1_increments", "p4_found", "p4_cover", "p5_agreement", "p7_found"])
def test_found_matches_sql(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from oracle import compare, duck

    from quernstone.llm import catalogue

    assert compare(spark, duck("/root/testdata/sf0.001"), catalogue.QUERIES[name], catalogue.ORACLES[name], "/root/testdata/sf0.001") == ""
