"""Connected components by minimum hooking and pointer jumping on contracted edges.

Every round hooks each root to its least neighbouring root, flattens the hooks by pointer jumping and rewrites the edges to
the new roots; edges inside a component vanish, so a round works on what the last one left. A node with a third of all
edges is only ever aggregated (with map-side combine) or joined through ``salted_join``. Nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.materialize import discard, materialize
from quernstone.plans.skew import salted_join


def flatten(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: (node, root) until every root is its own root. Hooks always go to smaller nodes: no cycles."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        jumped = materialize(
            salted_join(hooks, up, "root", "left").select("node", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("__moved")), "jump"
        )
        discard(hooks)
        moved = not jumped.where("__moved").isEmpty()
        nxt = jumped.select("node", "root")
        nxt._quernstone_path = jumped._quernstone_path
        hooks = nxt
        if not moved:
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node named in ``edges``; the component is its least node. Edges with a null end join
    nothing, but their other end is a node."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    links = materialize(pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        # the larger end of each link hooks to its least neighbour; ends that are nobody's larger end are roots
        hooks = flatten(materialize(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks"))
        rounds.append(hooks)
        ra, rb = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"__{c}")) for c in "ab")
        # after hooking, every b has a root; an a without a hook is itself a root
        moved = salted_join(salted_join(links, ra, "a", "left"), rb, "b", "left").select(F.coalesce("__a", "a").alias("x"), F.coalesce("__b", "b").alias("y"))
        left = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(links)
        links = left
    discard(links)
    out = nodes.select("node", F.col("node").alias("component"))
    for hooks in rounds:
        up = hooks.select(F.col("node").alias("component"), F.col("root").alias("__up"))
        out = salted_join(out, up, "component", "left", hot=None if len(rounds) > 1 and hooks is not rounds[0] else []).select("node", F.coalesce("__up", "component").alias("component"))
    done = materialize(out, "components")
    for hooks in rounds:
        discard(hooks)
    return done
