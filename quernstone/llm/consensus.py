"""Consensus from several annotators' labels by minimax conditional entropy.

The probability that annotator i gives label k to an item j of true class c is proportional to
exp(sigma[i, c, k] + tau[j, c, k]): annotators and items tilt it. Label posteriors alternate with a regularised dual ascent in
the tilts, one coordinate block (all tilts of one annotator, or of one item) after the other, each by a few damped Newton steps
on the diagonal. The tilts of items stay with the items; those of annotators are one array, sent to the tasks and gathered as
sums, so a round moves annotators x classes x labels numbers for each task and no rows.

A class is a conflict type, with a scope relation if that is conditional. A conditional label without a scope is an observation
of its own: it says conditional and leaves the scope open.

Defined results: of an annotator's labels for an item the latest counts (of equal times the greatest label); unknown labels and
rows without item, annotator or readable time take no part; repeated rows count once; items without any label get no row; of
equal posteriors the class that comes first wins; empty tables give empty results.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.materialize import materialize
from quernstone.sources.tables import table

# The labels.
TYPES = ("no_conflict", "temporal", "factual", "opinion")
SCOPES = ("refinement", "disjoint", "redundant", "opposed")
CLASSES = tuple((t, "none") for t in TYPES) + tuple(("conditional", s) for s in SCOPES)
OPEN = len(CLASSES)  # the observation "conditional, scope not given"
LABELS = OPEN + 1
FIRST_SCOPE = len(TYPES)


def label_index(conflict_type: Column, scope_relation: Column) -> Column:
    """Number of the observation, or null; case, outer spaces, hyphens and spaces for underscores do not matter."""
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    t, s = fold(conflict_type), fold(scope_relation)
    plain = F.array_position(F.array(*map(F.lit, TYPES)), t)
    scope = F.coalesce(F.array_position(F.array(*map(F.lit, SCOPES)), s), F.lit(0))
    return F.when(plain > 0, plain - 1).when(t == "conditional", F.when(scope > 0, scope - 1 + FIRST_SCOPE).otherwise(F.lit(OPEN))).cast("int")


def ballots(passes: DataFrame) -> DataFrame:
    """(item, annotator, label): the latest label of each annotator for each item."""
    p = passes.select(F.col("instance_id").alias("item"), "annotator", label_index(F.col("conflict_type"), F.col("scope_relation")).alias("label"), F.try_to_timestamp(F.col("labelled_at")).alias("at"))
    p = p.where("item IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL AND at IS NOT NULL")
    return p.groupBy("item", "annotator").agg(F.max(F.struct("at", "label"))["label"].alias("label"))


class Ballots:
    """The ballots of a batch of items, in the order of items, and in the order of annotators."""

    def __init__(self, b: pd.DataFrame):
        sizes = b["who"].map(len).to_numpy()
        self.n = len(b)
        self.who = np.concatenate(b["who"].tolist())
        self.label = np.concatenate(b["label"].tolist())
        self.item = np.repeat(np.arange(self.n), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.given = np.eye(LABELS, dtype=np.float32)[self.label]
        self.by_who = np.argsort(self.who, kind="stable")
        self.people, self.first_of = np.unique(self.who[self.by_who], return_index=True)

    def per_item(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first, axis=0)

    def add_per_person(self, total: np.ndarray, x: np.ndarray) -> None:
        total[self.people] += np.add.reduceat(x[self.by_who], self.first_of, axis=0)

    def probabilities(self, sigma: np.ndarray, tau: np.ndarray | None) -> np.ndarray:
        """P(label | class) of every ballot, class and label."""
        z = sigma[self.who] if tau is None else sigma[self.who] + tau[self.item]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def posterior(self, p: np.ndarray, prior: np.ndarray) -> np.ndarray:
        log_p = np.log(np.take_along_axis(p, self.label[:, None, None], axis=2)[:, :, 0] + 1e-30)
        out = self.per_item(log_p) + np.log(prior)
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        return out / out.sum(axis=1, keepdims=True)

    def log_likelihood(self, p: np.ndarray, prior: np.ndarray) -> float:
        """Of all labels, their items' classes summed out."""
        log_p = np.log(np.take_along_axis(p, self.label[:, None, None], axis=2)[:, :, 0] + 1e-30)
        z = self.per_item(log_p) + np.log(prior)
        top = z.max(axis=1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1))).sum())

    def item_tilts(self, sigma: np.ndarray, post: np.ndarray, weight: float, steps: int) -> np.ndarray:
        """Dual ascent in the items' tilts, given posteriors and annotators' tilts."""
        w = post[self.item][:, :, None]
        seen = self.per_item(w * self.given[:, None, :])
        tau = np.zeros_like(seen)
        for _ in range(steps):
            p = self.probabilities(sigma, tau)
            wp = w * p
            tau += (seen - self.per_item(wp) - tau * weight) / (self.per_item(wp * (1 - p)) + weight)
        return tau


def _added(parts: DataFrame) -> np.ndarray | None:
    """The sum of arrays of one size, emitted as (salt, sums): at most 64 of them reach the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"salt": pdf["salt"][:1], "sums": [sum(np.frombuffer(bytes(x)) for x in pdf["sums"]).tobytes()]})

    rows = parts.groupBy("salt").applyInPandas(add, "salt int, sums binary").collect()
    return sum(np.frombuffer(bytes(r["sums"])) for r in rows) if rows else None


def minimax_entropy(votes: DataFrame, rounds: int = 40, tolerance: float = 2e-4, annotator_weight: float = 2.0, item_weight: float = 4.0, steps: int = 2) -> tuple[DataFrame, DataFrame]:
    """``votes`` (item, annotator, label) to posteriors (item, posterior array<double>, n_votes, agreement, entropy) and
    annotators (annotator, n_items, reliability, matrix).

    Rounds end when the log-likelihood of the labels rises by less than ``tolerance`` of itself, or after ``rounds``.

    Annotators are people: their tilts, 576 bytes each, are held on the driver and sent to every task.
    """
    spark = votes.sparkSession
    k, m = len(CLASSES), LABELS
    names = [r["annotator"] for r in votes.select("annotator").distinct().orderBy("annotator").collect()]
    people = spark.createDataFrame(list(zip(names, range(len(names)))), "annotator string, who int")
    packed = materialize(votes.join(people, "annotator").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("who", "label"))).alias("v")).select("item", F.col("v.who").alias("who"), F.col("v.label").alias("label")), "ballots")  # an item has as many labels as annotators at most
    n = max(1, len(names))
    compatible = np.eye(m)[:k].copy()
    compatible[FIRST_SCOPE:, OPEN] = 1
    sigma = np.tile(np.log(0.7 * compatible / compatible.sum(axis=1, keepdims=True) + 0.3 / m), (n, 1, 1))
    prior, before = np.full(k, 1 / k), -np.inf
    for r in range(rounds if names else 0):
        shared = spark.sparkContext.broadcast((sigma.astype(np.float32), prior.astype(np.float32), r > 0))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, pr, tilt = shared.value
            seen, expected, curve, mass, fit = np.zeros_like(s), np.zeros_like(s), np.zeros_like(s), np.zeros(len(pr)), 0.0
            for b in batches:
                if not len(b):
                    continue
                v = Ballots(b)
                p = v.probabilities(s, None)
                post = v.posterior(p, pr)
                if tilt:
                    p = v.probabilities(s, v.item_tilts(s, post, item_weight, steps))
                    post = v.posterior(p, pr)
                w = post[v.item][:, :, None]
                v.add_per_person(seen, w * v.given[:, None, :])
                wp = w * p
                v.add_per_person(expected, wp)
                v.add_per_person(curve, wp * (1 - p))
                mass += post.sum(axis=0)
                fit += v.log_likelihood(p, pr)
            sums = np.concatenate([*(x.ravel().astype(np.float64) for x in (seen, expected, curve, mass)), [fit]])
            yield pd.DataFrame({"salt": np.array([TaskContext.get().partitionId() % 64], dtype=np.int32), "sums": [sums.tobytes()]})

        total = _added(packed.select("who", "label").mapInPandas(run, "salt int, sums binary"))
        if total is None:
            break
        size = n * k * m
        seen, expected, curve = (total[i * size : (i + 1) * size].reshape(n, k, m) for i in range(3))
        mass, fit = total[3 * size : -1], total[-1]
        if r == 0:  # counts as a start: what the plain posteriors say of each annotator
            smooth = 1.5 * compatible / compatible.sum(axis=1, keepdims=True) + 0.15
            sigma = np.log((seen + smooth) / (seen + smooth).sum(axis=2, keepdims=True))
        else:
            base = np.log(compatible / compatible.sum(axis=1, keepdims=True) * 0.7 + 0.3 / m)
            sigma = sigma + (seen - expected - (sigma - base) * 0.1 * annotator_weight) / (curve + 0.1 * annotator_weight)
            sigma = np.clip(sigma - sigma.max(axis=2, keepdims=True), -9, 0)
        prior = (mass + 1) / (mass.sum() + k)
        if r > 1 and fit - before < tolerance * abs(fit):
            break
        before = fit
    shared = spark.sparkContext.broadcast((sigma.astype(np.float32), prior.astype(np.float32)))
    kind = votes.schema["item"].dataType.simpleString()

    def label_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, pr = shared.value
        for b in batches:
            if not len(b):
                continue
            own = Ballots(b)
            post = own.posterior(own.probabilities(s, None), pr)
            post = own.posterior(own.probabilities(s, own.item_tilts(s, post, item_weight, steps)), pr).astype(np.float64)
            counts = own.per_item(own.given)
            v = counts.sum(axis=1)
            # conditional with the scope left open agrees with conditional in any scope
            pairs = (counts * (counts - 1)).sum(axis=1) + 2 * counts[:, OPEN] * counts[:, FIRST_SCOPE:OPEN].sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                agree = np.where(v > 1, pairs / (v * (v - 1)), np.nan)
            yield pd.DataFrame({"item": b["item"], "posterior": list(post), "n_votes": v.astype("int64"), "agreement": pd.Series(agree).where(~np.isnan(agree), None), "entropy": -(post * np.log(post + 1e-300)).sum(axis=1)})

    labelled = packed.mapInPandas(label_items, f"item {kind}, posterior array<double>, n_votes bigint, agreement double, entropy double")
    p = np.exp(sigma - sigma.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    right = p[:, np.arange(k), np.arange(k)].copy()
    right[:, FIRST_SCOPE:] += p[:, FIRST_SCOPE:, OPEN]
    rows = [(names[i], float((prior * right[i]).sum()), [[float(x) for x in y] for y in p[i]]) for i in range(len(names))]
    annotators = spark.createDataFrame(rows, "annotator string, reliability double, matrix array<array<double>>")
    return labelled, votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_items")).join(annotators, "annotator")


def decided(posteriors: DataFrame) -> DataFrame:
    """(instance_id, conflict_type, scope_relation, ...): the likeliest type, and of a conditional the likeliest scope."""
    p = F.col("posterior")
    conditional = sum((p[i] for i in range(FIRST_SCOPE, len(CLASSES))), F.lit(0.0))
    by_type = F.concat(F.slice(p, 1, FIRST_SCOPE), F.array(conditional))
    scopes = F.slice(p, FIRST_SCOPE + 1, len(SCOPES))
    best = lambda a, names: F.element_at(F.array(*map(F.lit, names)), F.array_position(a, F.array_max(a)).cast("int"))
    d = posteriors.withColumn("conflict_type", best(by_type, (*TYPES, "conditional")))
    scope = F.when(F.col("conflict_type") == "conditional", best(scopes, SCOPES)).otherwise(F.lit("none"))
    return d.select(F.col("item").alias("instance_id"), "conflict_type", scope.alias("scope_relation"), F.array_max(by_type).alias("confidence"), "n_votes", "agreement", "entropy")


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per item, its confidence and the agreement of its annotators."""
    votes = materialize(ballots(table(spark, sf_dir, "label_passes")), "votes")
    return decided(minimax_entropy(votes)[0])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per item."""
    return p5_consensus(spark, sf_dir).select("instance_id", "conflict_type", "scope_relation")


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each annotator."""
    votes = materialize(ballots(table(spark, sf_dir, "label_passes")), "votes")
    return minimax_entropy(votes)[1].drop("matrix")


def krippendorff(votes: DataFrame, unit: str, value: str, name: str) -> DataFrame:
    """(level, n_items, n_labels, observed, expected, alpha): agreement over all units with two labels or more, corrected for chance
    (nominal alpha). One row; alpha is null where all labels are one."""
    cells = votes.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    seen = sizes.agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_labels"), F.sum(F.col("same") / (F.col("m") - 1)).alias("agree"))
    totals = cells.join(sizes.select(unit), unit, "left_semi").groupBy(value).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("chance"))
    d = seen.crossJoin(F.broadcast(totals))  # one row each
    n = F.col("n_labels").cast("double")
    return d.select(
        F.lit(name).alias("level"), "n_items", "n_labels", F.round(F.col("agree") / n, 6).alias("observed"), F.round(F.col("chance") / (n * (n - 1)), 6).alias("expected"),
        F.round(1 - F.try_divide(1 - F.col("agree") / n, 1 - F.col("chance") / (n * (n - 1))), 6).alias("alpha"),
    )


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of all annotators over all items: on the type, and on the scope of what both call conditional with a scope."""
    votes = materialize(ballots(table(spark, sf_dir, "label_passes")), "votes")
    names = F.array(*map(F.lit, (*TYPES, *["conditional"] * (len(SCOPES) + 1))))
    kinds = F.element_at(names, F.col("label") + 1)
    scopes = F.when((F.col("label") >= FIRST_SCOPE) & (F.col("label") < OPEN), F.col("label"))
    v = votes.select("item", kinds.alias("kind"), scopes.alias("scope"))
    return krippendorff(v, "item", "kind", "conflict_type").unionByName(krippendorff(v, "item", "scope", "scope_relation"))


QUERIES = {"p5_found": p5_found, "p5_consensus": p5_consensus, "p5_annotators": p5_annotators, "p5_agreement": p5_agreement}
ORACLES = {
    "p5_agreement": r"""
WITH b AS (SELECT instance_id AS item, annotator, try_cast(labelled_at AS TIMESTAMPTZ) AS ts, regexp_replace(lower(trim(conflict_type)), '[\s_-]+', '_', 'g') AS t,
  regexp_replace(lower(trim(scope_relation)), '[\s_-]+', '_', 'g') AS s FROM label_passes WHERE instance_id IS NOT NULL AND annotator IS NOT NULL),
l AS (SELECT item, annotator, ts, CASE WHEN list_contains(['no_conflict', 'temporal', 'factual', 'opinion'], t) THEN list_position(['no_conflict', 'temporal', 'factual', 'opinion'], t) - 1
  WHEN t = 'conditional' THEN coalesce(list_position(['refinement', 'disjoint', 'redundant', 'opposed'], s) + 3, 8) END AS label FROM b),
v AS (SELECT item, max(x).label AS label FROM (SELECT item, annotator, {'ts': ts, 'label': label} AS x FROM l WHERE label IS NOT NULL AND ts IS NOT NULL) GROUP BY item, annotator),
k AS (SELECT 'conflict_type' AS level, item, CASE WHEN label >= 4 THEN 'conditional' ELSE label::VARCHAR END AS value FROM v
  UNION ALL SELECT 'scope_relation', item, label::VARCHAR FROM v WHERE label BETWEEN 4 AND 7),
c AS (SELECT level, item, value, count(*) AS n FROM k GROUP BY ALL),
z AS (SELECT level, item, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT level, count(*) AS n_items, sum(m) AS n, sum(same / (m - 1)) AS agree FROM z GROUP BY level),
e AS (SELECT level, sum(t * (t - 1)) AS chance FROM (SELECT level, value, sum(n) AS t FROM c SEMI JOIN z USING (level, item) GROUP BY level, value) GROUP BY level)
SELECT level, n_items, n::BIGINT AS n_labels, round(agree / n, 6) AS observed, round(chance / (n * (n - 1)), 6) AS expected, round(1 - (1 - agree / n) / (1 - chance / (n * (n - 1))), 6) AS alpha FROM o JOIN e USING (level)
"""
}
