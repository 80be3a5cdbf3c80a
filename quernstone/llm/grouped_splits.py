"""Train, validation and test splits that keep related records together.

Records that share a key (an author, a page, an entity), or are one record, belong to one component, directly or through other
records. ``update_components`` keeps what it knows in a store and adds a batch to it:

* ``nodes`` (node, component) and ``records`` (id, component) are only ever appended to;
* a batch's keys are looked up there, so a stored component is a single node of the batch's graph, and only the batch is contracted
  (hooking and pointer jumping, ``plans.components``). Components of the store that a batch merges get a pointer to the least of
  them; pointers are followed by pointer jumping, and no stored row is rewritten;
* ``groups`` (component, splits, n) holds, of the components a batch touched, the splits their members came with or were dealt, and
  how many records they have. The latest row of a component counts.

A component with one split keeps it; one with several is quarantined, stays so, and has no split; one without is dealt into the
deficits of the target shares, taken over all that is stored and all that is new. A batch is written as one version, which counts
once it is whole, so a run that is lost leaves the store as it was.

Defined results: a null key links nothing; a record without any key is a component of its own; a null or unknown split is
no split; records with a null id are not returned (they still link their keys); repeated rows count once; empty tables give
empty results; columns other than those named are ignored, whatever their names.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.urls import canonical_page
from quernstone.plans.components import components, flatten
from quernstone.plans.materialize import discard, materialize, shared_dir
from quernstone.plans.skew import salted_join
from quernstone.sources.tables import table

RATIOS = {"train": 0.6, "dev": 0.2, "test": 0.2}
#: Components with more than 1/LARGE of all records are placed one by one; there are fewer than LARGE of them.
LARGE = 200
#: Hash buckets by which the other components are dealt out; their sizes are the only thing gathered.
BUCKETS = 4096


def folded(c: Column) -> Column:
    """Compared without case and outer spaces; blank is null."""
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def _dealt(sizes: DataFrame, held: dict[str, int], ratios: dict[str, float]) -> DataFrame:
    """(component, split) for components of ``sizes`` (component, n) that have no split: they fill the deficits."""
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return sizes.select("component", F.lit(None).cast("string").alias("split")).limit(0)
    want = {s: r * (total + sum(held.values())) - held.get(s, 0) for s, r in ratios.items()}
    large = sizes.where(F.col("n") > total / LARGE).orderBy(F.desc("n"), "component").collect()  # fewer than LARGE rows
    placed = []
    for r in large:
        s = max(want, key=lambda k: (want[k], k))
        want[s] -= r["n"]
        placed.append((r["component"], s))
    big = spark.createDataFrame(placed, "component string, split string")
    small = sizes.join(F.broadcast(big), "component", "left_anti") if placed else sizes
    bucket = F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")
    small = small.withColumn("bucket", bucket)
    rows = small.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    weight = {r["bucket"]: r["n"] for r in rows}
    want = {s: max(0.0, w) for s, w in want.items()}
    scale = sum(weight.values()) / (sum(want.values()) or 1)
    edges, at = [], 0.0
    for s in ratios:
        at += want[s] * scale
        edges.append((s, at))
    chosen, run = [], 0.0
    for b in range(BUCKETS):  # a bucket goes to the split in which its middle lies
        mid = run + weight.get(b, 0) / 2
        run += weight.get(b, 0)
        chosen.append(next((s for s, e in edges if mid < e), edges[-1][0]))
    dealt = small.select("component", F.element_at(F.array(*map(F.lit, chosen)), F.col("bucket") + 1).alias("split"))
    return dealt.unionByName(big) if placed else dealt


NONE = "array<string>"


def update_components(records: DataFrame, links: DataFrame, ratios: dict[str, float] = RATIOS, store: str | None = None) -> DataFrame:
    """``records`` (id, keys array<string>, split) and further ``links`` (a, b) between keys to
    (id, component, present, splits_present, split, quarantined, n_component), a row for each record of the batch.

    ``store``: folder of the persisted tables, in versions.
    """
    spark = records.sparkSession
    empty = F.array().cast(NONE)
    r = records.select("id", F.array_sort(F.filter(F.coalesce("keys", empty), lambda k: k.isNotNull())).alias("keys"), F.col("split").alias("present"))
    r = r.withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(F.concat(F.lit("record|"), F.col("id").cast("string")))))
    r = materialize(r.withColumn("anchor", F.col("keys")[0]).where("anchor IS NOT NULL").distinct(), "records")
    edges = r.select(F.col("anchor").alias("a"), F.explode("keys").alias("b")).unionByName(links.select("a", "b")).distinct()
    known = _read(spark, store)
    if known:
        at = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known["nodes"], "node"), "known-nodes")
        again = materialize(r.where("id IS NOT NULL").select("id", "anchor").join(known["records"], "id"), "known-records")
        # keys of the store stand for their component
        edges = edges.unionByName(at.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(again.select(F.col("anchor").alias("a"), F.col("component").alias("b"))).distinct()
    labels = components(edges)
    placed = salted_join(r, labels.withColumnRenamed("node", "anchor"), "anchor")
    if known:
        # a component of the store that the batch meets is a node of the batch's graph; the least of those merged is the name
        met = materialize(labels.join(known["groups"].withColumnRenamed("component", "node"), "node"), "met")
        name = met.groupBy("component").agg(F.min("node").alias("name"))
        rename = lambda d: salted_join(d, name, "component", "left").withColumn("component", F.coalesce("name", "component")).drop("name")
        labels, placed, met = rename(labels), rename(placed), rename(met)
    votes = placed.select("component", F.col("present").alias("s")).where(F.col("s").isin(*ratios))
    fresh_ids = placed.where("id IS NOT NULL").select("id", "component").distinct()
    if known:
        votes = votes.unionByName(met.select("component", F.explode("splits").alias("s")))
        fresh_ids = fresh_ids.join(again.select("id").distinct(), "id", "left_anti")
    fresh_ids = materialize(fresh_ids, "fresh-records")
    sizes = labels.select("component").distinct().join(fresh_ids.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component", "left").fillna(0, ["n"])
    if known:
        sizes = sizes.join(met.groupBy("component").agg(F.sum("n").alias("held")), "component", "left").select("component", (F.col("n") + F.coalesce("held", F.lit(0))).alias("n"))
    facts = votes.groupBy("component", "s").agg(F.count(F.lit(1)).alias("v")).groupBy("component").agg(F.sort_array(F.collect_set("s")).alias("splits"))  # at most len(ratios) values
    state = materialize(sizes.join(facts, "component", "left").withColumn("splits", F.coalesce("splits", empty)), "state")
    counted = state.where("size(splits) = 1").select(F.col("splits")[0].alias("split"), "n")
    if known:  # what the batch did not touch holds its share too
        rest = known["groups"].join(met.select(F.col("node").alias("component")), "component", "left_anti")
        counted = counted.unionByName(rest.where("size(splits) = 1").select(F.col("splits")[0].alias("split"), "n"))
    held = {x["split"]: x["n"] for x in counted.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # a row for each split
    fresh = _dealt(state.where("size(splits) = 0 AND n > 0").select("component", "n"), held, ratios)
    decided = state.join(fresh.withColumnRenamed("split", "dealt"), "component", "left")
    decided = decided.select("component", F.col("n").alias("n_component"), F.col("splits").alias("splits_present"), F.when(F.size("splits") == 1, F.col("splits")[0]).when(F.size("splits") == 0, F.col("dealt")).alias("split"), (F.size("splits") > 1).alias("quarantined"))
    decided = materialize(decided, "decided")
    if store:
        v = f"{store}/v={1 + max([0, *_versions(spark, store)])}-{uuid.uuid4().hex}"
        new = labels.join(at.select("node"), "node", "left_anti").join(known["groups"].select(F.col("component").alias("node")), "node", "left_anti") if known else labels
        new.select("node", "component").write.parquet(f"{v}/nodes")
        fresh_ids.write.parquet(f"{v}/records")
        pointers = met.where("node <> component").select("node", F.col("component").alias("root")) if known else labels.select("node", F.col("component").alias("root")).limit(0)
        pointers.write.parquet(f"{v}/pointers")
        splits = F.when((F.size("splits_present") == 0) & F.col("split").isNotNull(), F.array("split")).otherwise(F.col("splits_present"))
        decided.select("component", splits.alias("splits"), F.col("n_component").alias("n")).write.parquet(f"{v}/groups")  # last: a version counts once this is whole
    out = salted_join(placed.where("id IS NOT NULL").select("id", "present", "component"), decided, "component").select(
        "id", "component", "present", "splits_present", "split", "quarantined", "n_component"
    )
    discard(fresh_ids)
    return out


def _versions(spark: SparkSession, store: str) -> dict[int, str]:
    """The whole versions of a store and their folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/groups/_SUCCESS"))
    return {int(n[2:].split("-")[0]): n for n in names if n.startswith("v=") and done(n)}


def _read(spark: SparkSession, store: str | None) -> dict[str, DataFrame]:
    """The tables of a store as they stand: nodes and records with their present component, groups of present components."""
    versions = _versions(spark, store) if store else {}
    if not versions:
        return {}
    read = lambda t: spark.read.parquet(*[f"{store}/{n}/{t}" for n in versions.values()])
    roots = flatten(materialize(read("pointers").distinct(), "pointers")).withColumnRenamed("node", "component")
    present = lambda d: d.join(roots, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
    groups = read("groups").withColumn("v", F.regexp_extract(F.input_file_name(), r"/v=(\d+)-", 1).cast("int"))
    groups = groups.groupBy("component").agg(F.max_by(F.struct("splits", "n"), "v").alias("g")).select("component", "g.splits", "g.n")
    groups = groups.join(roots, "component", "left_anti")  # merged ones live on in the component they point to
    return {"nodes": present(read("nodes")), "records": present(read("records")), "groups": materialize(groups, "groups")}


def stored_splits(spark: SparkSession, store: str) -> DataFrame:
    """(id, component, split, quarantined, n_component) of every record of a store."""
    known = _read(spark, store)
    g = known["groups"].select("component", F.when(F.size("splits") == 1, F.col("splits")[0]).alias("split"), (F.size("splits") > 1).alias("quarantined"), F.col("n").alias("n_component"))
    return salted_join(known["records"], g, "component").select("id", "component", "split", "quarantined", "n_component")


def question_splits(spark: SparkSession, sf_dir: str, store: str | None = None, received: Column | None = None) -> DataFrame:
    """The operator over questions, or those ``received`` then, linked by doc, page and asker."""
    q = table(spark, sf_dir, "questions")
    q = q if received is None else q.where(received)
    doc = F.concat(F.lit("doc|"), F.col("doc").cast("string"))
    asker = F.concat(F.lit("asker|"), folded(F.col("asker")))
    records = q.select(F.col("qid").alias("id"), F.array(doc, asker).alias("keys"), folded(F.col("split")).alias("split")).distinct()
    g = table(spark, sf_dir, "guide_docs")
    links = g.select(doc.alias("a"), F.concat(F.lit("page|"), canonical_page(F.col("url"))).alias("b")).distinct()
    return update_components(records, links, store=store)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid of every question in a quarantined group."""
    return question_splits(spark, sf_dir).where("quarantined").select(F.col("id").alias("qid")).distinct()


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every question."""
    return question_splits(spark, sf_dir).select(F.col("id").alias("qid"), "component", "split", "quarantined").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and groups per split, as reached."""
    s = p1_splits(spark, sf_dir)
    one = s.groupBy("component", "split", "quarantined").agg(F.count(F.lit(1)).alias("n"))
    by = one.groupBy("split").agg(F.sum("n").alias("n_questions"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("quarantined").cast("bigint")).alias("n_quarantined"))
    # the window holds a row for each split
    return by.select("*", (F.col("n_questions") / F.sum("n_questions").over(Window.partitionBy(F.lit(0)))).alias("share"))


def p1_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions in two deliveries, the second added to what the first left in a store: the group of each, named by its least
    question, and its stored size."""
    q = table(spark, sf_dir, "questions")
    first, last = q.agg(F.min("received_at"), F.max("received_at")).first()
    early = F.coalesce(F.col("received_at") < F.lit(first + (last - first) / 2), F.lit(False)) if first else F.lit(False)
    store = f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}/p1-{uuid.uuid4().hex}"
    for batch in (early, ~early):
        question_splits(spark, sf_dir, store, batch)
    s = materialize(stored_splits(spark, store), "stored")
    least = s.groupBy("component").agg(F.min("id").alias("group_qid"))
    return salted_join(s, least, "component").select(F.col("id").alias("qid"), "group_qid", "n_component")


QUERIES = {"p1_increments": p1_increments, "p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares}

P1_GROUPS = r"""
WITH RECURSIVE q AS (SELECT DISTINCT qid, doc, lower(trim(asker)) AS asker, lower(trim(split)) AS split FROM questions),
u AS (SELECT DISTINCT doc, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '#.*$', '') AS u FROM guide_docs WHERE url IS NOT NULL),
cut AS (SELECT doc, regexp_replace(regexp_replace(split_part(u, '?', 1), '^www\.', ''), ':(80|443)(/|$)', '\2') AS p,
               list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_\w+|ref|referrer|source|print|fbclid|gclid|share|session|sid|amp)(=.*)?|page=1|p=1|start=0|offset=0'))) AS args FROM u),
pages AS (SELECT DISTINCT doc, regexp_replace(regexp_replace(p, '/+', '/', 'g'), '/(index\.html?)?$', '') || '?' || array_to_string(args, '&') AS page FROM cut),
near AS (SELECT DISTINCT a.doc AS a, b.doc AS b FROM pages a JOIN pages b USING (page)
         UNION SELECT DISTINCT a.doc, b.doc FROM q a JOIN q b ON a.asker = b.asker),
reach(root, doc) AS (SELECT DISTINCT doc, doc FROM q UNION SELECT r.root, n.b FROM reach r JOIN near n ON n.a = r.doc),
lab AS (SELECT doc, min(root) AS g FROM reach GROUP BY doc),
bad AS (SELECT g FROM q JOIN lab USING (doc) WHERE split IN ('train', 'dev', 'test') GROUP BY g HAVING count(DISTINCT split) > 1)
"""
ORACLES = {
    "p1_found": P1_GROUPS + "SELECT DISTINCT qid FROM q JOIN lab USING (doc) WHERE g IN (SELECT g FROM bad)",
    "p1_increments": P1_GROUPS + """, m AS (SELECT DISTINCT qid, g FROM q JOIN lab USING (doc) WHERE qid IS NOT NULL)
SELECT qid, min(qid) OVER (PARTITION BY g) AS group_qid, count(*) OVER (PARTITION BY g) AS n_component FROM m""",
}
