"""What two frames speak about: slots with values of a taxonomy, unified slot by slot.

A frame's signature is a row for each slot: ``typed``, a value of the vocabulary, or ``untyped``, what was said where the vocabulary
does not know it. The root of a slot says nothing and is left out. Unifying joins the slots of both frames with the closure of the
taxonomy; no pair of values is looked up more than once, and nothing is gathered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.scope import closure
from quernstone.plans.components import components


def folded(c: Column) -> Column:
    return F.lower(F.trim(c))


def ancestors(taxonomy: DataFrame) -> DataFrame:
    """``taxonomy`` (slot, value, parent) to (slot, value, ancestor), each value its own ancestor."""
    tag = lambda c: F.concat_ws("|", "slot", c)
    c = closure(taxonomy.select(tag("value").alias("child"), tag("parent").alias("parent")))
    part = lambda c, i: F.split_part(c, F.lit("|"), F.lit(i))
    return c.select(part("node", 1).alias("slot"), part("node", 2).alias("value"), part("ancestor", 2).alias("ancestor"))


def signatures(raw: DataFrame, taxonomy: DataFrame, roots: dict[str, str], aliases: DataFrame | None = None) -> DataFrame:
    """``raw`` (frame, slot, value) to (frame, slot, typed, untyped). Values are folded and aliases replaced; blank values and roots
    are left out; of two values of a slot the least stands."""
    r = raw.select("frame", "slot", folded(F.col("value")).alias("value")).where("value <> ''")
    if aliases is not None:
        r = r.join(aliases.select("slot", folded(F.col("alias")).alias("value"), F.col("value").alias("named")), ["slot", "value"], "left").withColumn("value", F.coalesce("named", "value"))
    known = taxonomy.select("slot", "value").unionByName(taxonomy.select("slot", F.col("parent").alias("value"))).distinct().withColumn("known", F.lit(True))
    r = r.join(known, ["slot", "value"], "left")
    for slot, root in roots.items():
        r = r.where(~((F.col("slot") == slot) & (F.col("value") == root)))
    typed = F.coalesce("known", F.lit(False))
    return r.groupBy("frame", "slot").agg(F.min(F.when(typed, F.col("value"))).alias("typed"), F.min(F.when(~typed, F.col("value"))).alias("untyped"))


def slot_relations(pairs: DataFrame, sigs: DataFrame, above: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of frames and their ``sigs`` to (a, b, slot, relation): equal, a_broader, b_broader, incompatible or uncertain, of
    every slot that one of them has. A frame without a slot is the broader one there; free text against a value is uncertain."""
    own = lambda k: sigs.select(F.col("frame").alias(k), "slot", F.col("typed").alias(f"t{k}"), F.col("untyped").alias(f"u{k}"))
    slots = pairs.join(own("a").select("a", "slot"), "a").unionByName(pairs.join(own("b").select("b", "slot"), "b").select("a", "b", "slot")).distinct()
    j = slots.join(own("a"), ["a", "slot"], "left").join(own("b"), ["b", "slot"], "left")
    up = lambda low, high, name: above.select("slot", F.col("value").alias(low), F.col("ancestor").alias(high), F.lit(True).alias(name))
    j = j.join(up("tb", "ta", "a_above"), ["slot", "ta", "tb"], "left").join(up("ta", "tb", "b_above"), ["slot", "ta", "tb"], "left")
    a, b = F.col("ta").isNotNull(), F.col("tb").isNotNull()
    ua, ub = F.col("ua").isNotNull() & ~a, F.col("ub").isNotNull() & ~b
    rel = (
        F.when(ua & ub, F.when(F.col("ua") == F.col("ub"), "equal").otherwise("uncertain")).when(ua & ~b, "b_broader").when(ub & ~a, "a_broader").when(ua | ub, "uncertain")
        .when(~a, "a_broader").when(~b, "b_broader").when(F.col("ta") == F.col("tb"), "equal").when(F.col("a_above"), "a_broader").when(F.col("b_above"), "b_broader").otherwise("incompatible")
    )
    return j.select("a", "b", "slot", rel.alias("relation"))


def unify(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """(a, b, kind, general): distinct if any slot is incompatible, uncertain if any is, overlap if both are broader somewhere, subsumes
    with the broader side, else equivalent, which two frames without slots are."""
    any_ = lambda r: F.max((F.col("relation") == r).cast("int"))
    g = relations.groupBy("a", "b").agg(*[any_(r).alias(r) for r in ("incompatible", "uncertain", "a_broader", "b_broader")])
    j = pairs.join(g, ["a", "b"], "left").fillna(0, ["incompatible", "uncertain", "a_broader", "b_broader"])
    on = lambda c: F.col(c) == 1
    kind = F.when(on("incompatible"), "distinct").when(on("uncertain"), "uncertain").when(on("a_broader") & on("b_broader"), "overlap").when(on("a_broader") | on("b_broader"), "subsumes").otherwise("equivalent")
    return j.select("a", "b", kind.alias("kind"), F.when(kind == "subsumes", F.when(on("a_broader"), "a").otherwise("b")).alias("general"))


def coreferent(unified: DataFrame) -> DataFrame:
    """(frame, group): frames that speak of one thing, directly or through others; frames alone are groups of their own."""
    ends = unified.select("a", F.when(F.col("kind").isin("equivalent", "subsumes", "overlap"), F.col("b")).alias("b"))
    ends = ends.unionByName(unified.select(F.col("b").alias("a"), F.lit(None).cast("string").alias("b")))
    return components(ends).select(F.col("node").alias("frame"), F.col("component").alias("group"))


def folded_values(relations: DataFrame, sigs: DataFrame, above: DataFrame) -> DataFrame:
    """(a, b, side, slot, values): where a side is narrower in a slot, all values at or below its own: the constraint by which its scope
    is narrowed."""
    narrow = relations.where("relation IN ('a_broader', 'b_broader')").select("a", "b", "slot", F.when(F.col("relation") == "b_broader", "a").otherwise("b").alias("side"))
    own = narrow.withColumn("frame", F.when(F.col("side") == "a", F.col("a")).otherwise(F.col("b"))).join(sigs.where("typed IS NOT NULL").select("frame", "slot", "typed"), ["frame", "slot"])
    below = above.groupBy("slot", F.col("ancestor").alias("typed")).agg(F.array_sort(F.collect_set("value")).alias("values"))  # a vocabulary's values
    return own.join(below, ["slot", "typed"]).select("a", "b", "side", "slot", "values")


def decision(kind: Column, commensurable: Column, relation: Column, match: Column, hedged: Column) -> Column:
    """What two frames are to each other; null where they are not compared."""
    return (
        F.when(kind.isin("distinct", "uncertain") | ~commensurable, F.lit(None).cast("string")).when(hedged | (relation == "unknown"), "unknown").when(relation == "disjoint", "disjoint")
        .when(match, "redundant").when(relation == "equal", "same_scope").when(relation == "overlapping", "crossing").otherwise("conditional")
    )


def strongest(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest decision of each key: conditional, then crossing and same scope, redundant, disjoint, unknown; then the score."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"conditional": 5, "crossing": 4, "same_scope": 4, "redundant": 3, "disjoint": 2, "unknown": 1}.items() for x in kv]), F.col("decision"))
    return decisions.where("decision IS NOT NULL").groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), "score", "decision")).alias("best")).select(*keys, "best.decision", "best.score")
