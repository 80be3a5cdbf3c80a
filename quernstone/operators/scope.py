"""Set algebra over typed scopes: comparison, satisfiability, partition of a case space, taxonomy closure, intervals."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.matching import values_match
from quernstone.plans.materialize import discard, materialize

NEG_INF, POS_INF = float("-inf"), float("inf")
ATTRIBUTE = "struct<name:string,kind:string,values:array<string>,lo:double,hi:double,flag:boolean,text:string>"


# Kinds of attributes that hold a set of values, and that hold an interval; any other but boolean is free text.
SETS, INTERVALS = ("categorical", "ordered_tier"), ("numeric", "numeric_range")
TYPED = (*SETS, *INTERVALS, "boolean")


def folded(c: Column) -> Column:
    return F.lower(F.trim(c))


def attribute(a: Column) -> Column:
    """An attribute in common form: names and values folded, null bounds infinite."""
    values = F.transform(F.coalesce(a["values"], F.array().cast("array<string>")), folded)
    return F.struct(
        folded(a["name"]).alias("name"), a["kind"].alias("kind"), F.array_sort(F.array_distinct(values)).alias("values"),
        F.coalesce(a["min_value"].cast("double"), F.lit(NEG_INF)).alias("lo"), F.coalesce(a["max_value"].cast("double"), F.lit(POS_INF)).alias("hi"),
        a["boolean_value"].alias("flag"), a["text"].alias("text"),
    )


def attributes(a: Column) -> Column:
    """All attributes of a scope in common form."""
    return F.transform(F.coalesce(a, F.array()), attribute)


def attribute_relation(a: Column, b: Column) -> Column:
    """equal, subset (a in b), superset, overlapping, disjoint or unknown, of two attributes of one name. Of two kinds: overlapping,
    as neither can hold the other; of free text: unknown."""
    va, vb = a["values"], b["values"]
    common = F.size(F.array_intersect(va, vb))
    sets = F.when(common == 0, "disjoint").when((common == F.size(va)) & (common == F.size(vb)), "equal").when(common == F.size(va), "subset").when(common == F.size(vb), "superset").otherwise("overlapping")
    inside, around = (a["lo"] >= b["lo"]) & (a["hi"] <= b["hi"]), (b["lo"] >= a["lo"]) & (b["hi"] <= a["hi"])
    num = F.when((a["lo"] > b["hi"]) | (b["lo"] > a["hi"]), "disjoint").when(inside & around, "equal").when(inside, "subset").when(around, "superset").otherwise("overlapping")
    flag = F.when(a["flag"].eqNullSafe(b["flag"]), "equal").otherwise("disjoint")
    typed = F.when(a["kind"] != b["kind"], "overlapping").when(a["kind"].isin(*SETS), sets).when(a["kind"].isin(*INTERVALS), num).otherwise(flag)
    return F.when(a["kind"].isin(*TYPED) & b["kind"].isin(*TYPED), typed).otherwise("unknown")


def scope_relation(a: Column, b: Column, a_default: Column, b_default: Column) -> Column:
    """Of two conjunctions (arrays of attributes; of one name the last counts): a default holds everything; without an attribute on
    either side nothing is known; any disjoint attribute makes them disjoint; any free text on either side unknown; no shared name
    overlapping; an attribute only one side has narrows that side."""
    last = lambda x: F.filter(x, lambda y, i: ~F.exists(F.slice(x, i + 2, F.greatest(F.size(x), F.lit(1))), lambda z: z["name"] == y["name"]))
    a, b = last(a), last(b)
    names = lambda x: F.transform(x, lambda t: t["name"])
    shared = F.filter(a, lambda x: F.array_contains(names(b), x["name"]))
    rel = F.transform(shared, lambda x: attribute_relation(x, F.get(F.filter(b, lambda y: y["name"] == x["name"]), F.lit(0))))
    has = lambda k: F.array_contains(rel, k)
    free = lambda x: F.exists(x, lambda t: ~F.coalesce(t["kind"].isin(*TYPED), F.lit(False)))
    only_a, only_b = F.size(a) > F.size(shared), F.size(b) > F.size(shared)
    sub, sup = F.forall(rel, lambda r: r.isin("equal", "subset")) & ~only_b, F.forall(rel, lambda r: r.isin("equal", "superset")) & ~only_a
    typed = (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(has("disjoint"), "disjoint").when(free(a) | free(b), "unknown").when(F.size(shared) == 0, "overlapping")
        .when(sub & sup, "equal").when(sub, "subset").when(sup, "superset").otherwise("overlapping")
    )
    return F.when(a_default & b_default, "equal").when(a_default, "superset").when(b_default, "subset").otherwise(typed)


def narrower(relation: Column, a: Column, b: Column) -> Column:
    """Which of two scopes is strictly smaller; null if neither."""
    return F.when(relation == "subset", a).when(relation == "superset", b)


def exception_pair(relation: Column, agree: Column) -> Column:
    """nested or crossed, of two exceptions whose scopes meet and whose outcomes differ; null where both can stand."""
    return F.when(agree, F.lit(None).cast("string")).when(relation.isin("subset", "superset"), "nested").when(relation.isin("equal", "overlapping"), "crossed")


def verdict(relation: Column, agree: Column) -> Column:
    """The four-way relation of two claims from the relation of their scopes and whether their outcomes agree."""
    return F.when(relation == "disjoint", "disjoint").when(relation == "unknown", "opposed").when(agree, "redundant").when(relation.isin("subset", "superset"), "refinement").otherwise("opposed")


def intersects(relation: Column) -> Column:
    """Three-valued: null where the scopes cannot be compared."""
    return F.when(relation == "unknown", F.lit(None).cast("boolean")).otherwise(relation != "disjoint")


def merged_intervals(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Union of closed intervals by ``keys``: those that touch become one (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.where(f"`{lo}` <= `{hi}`").withColumn("__new", (before.isNull() | (F.col(lo) > before)).cast("int")).withColumn("__island", F.sum("__new").over(w))
    return d.groupBy(*keys, "__island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__island")


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance) of a taxonomy of any depth, each node its own ancestor at 0, by doubling: each round joins the paths
    known so far with themselves, so twice the length is reached, and ends when no pair is new. Lineage is cut in each round."""
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct()
    nodes = e.select(F.explode(F.array("c", "p")).alias("node")).distinct()
    least = lambda d: d.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
    paths = materialize(least(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("distance")).unionByName(e.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")))), "paths")
    known = paths.count()
    while True:
        up = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        grown = materialize(least(paths.join(up, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))), "paths")
        n, moved = grown.count(), grown.agg(F.sum("distance")).first()[0]
        done = n == known and moved == paths.agg(F.sum("distance")).first()[0]
        discard(paths)
        paths, known = grown, n
        if done:
            return paths


MOST = 8
Constraint = tuple[str, object]


def constraints(attributes: list[dict]) -> dict[str, Constraint] | None:
    """name -> (family, what is allowed); attributes of one name are intersected. None where something is free text, or one name has
    two kinds."""
    out: dict[str, Constraint] = {}
    for a in attributes:
        if a["kind"] in INTERVALS:
            own = ("interval", (a["lo"], a["hi"]))
        elif a["kind"] in SETS:
            own = ("set", frozenset(a["values"]))
        elif a["kind"] == "boolean":
            own = ("flag", frozenset([a["flag"]]))
        else:
            return None
        before = out.get(a["name"], own)
        if before[0] != own[0]:
            return None
        out[a["name"]] = (own[0], _meet(before, own))
    return out


def _meet(a: Constraint, b: Constraint):
    return (max(a[1][0], b[1][0]), min(a[1][1], b[1][1])) if a[0] == "interval" else a[1] & b[1]


def _some_value(family: str, allowed: list, excluded: list) -> bool:
    """Whether a value lies in all of ``allowed`` and in none of ``excluded``. Categories are an open world, numbers the reals."""
    if family == "set":
        return not allowed or bool(frozenset.intersection(*allowed).difference(*excluded))
    if family == "flag":
        return any(all(v in a for a in allowed) and not any(v in x for x in excluded) for v in (True, False))
    lo, hi = max([NEG_INF, *(a[0] for a in allowed)]), min([POS_INF, *(a[1] for a in allowed)])
    reached, open_end = lo, False  # everything in [lo, reached] is excluded so far, but for reached itself if nothing was
    for x_lo, x_hi in sorted(x for x in excluded if x[0] <= x[1]):
        if x_lo > reached:
            break
        if x_hi >= reached:
            reached, open_end = x_hi, True
    return lo <= hi and (reached < hi or not open_end)


def satisfiable(inside: list[dict], outside: list[dict]) -> bool:
    """Whether some case lies in every scope of ``inside`` and in none of ``outside`` (each name -> constraint; empty: everything).
    An excluded scope is left through one of its attributes; the ways out are tried one after the other."""
    must: dict[str, list[Constraint]] = {}
    for scope in inside:
        for name, c in scope.items():
            must.setdefault(name, []).append(c)

    def fits(name: str, out: list[Constraint]) -> bool:
        every = must.get(name, []) + out
        families = {f for f, _ in every}
        return len(families) <= 1 and (not every or _some_value(every[0][0], [v for _, v in must.get(name, [])], [v for _, v in out]))

    def leave(k: int, out: dict[str, list[Constraint]]) -> bool:
        if k == len(outside):
            return True
        for name, c in outside[k].items():
            tried = {**out, name: [*out.get(name, []), c]}
            if fits(name, tried[name]) and leave(k + 1, tried):
                return True
        return False

    return all(fits(name, []) for name in must) and leave(0, {})


def partition(frames: DataFrame, key: str) -> DataFrame:
    """``frames`` (key, frame, is_default, attributes, outcome) to the regions of each key's case space: (key, inside, governing,
    outcome, status), sets of frames as ids with blanks between.

    Every sign vector that some case satisfies is a region: assigned if the most specific frames inside agree in their outcome
    (``values_match``), else contested; uncovered where no frame is inside. Frames with free text, or with a name that another uses
    with another kind, give a row of their own, indeterminate; frames that no case satisfies are discarded. Signs that no case
    satisfies are not carried on, so the work follows the number of regions.
    """
    kind = dict(frames.dtypes)[key]
    one = F.struct("frame", "is_default", "attributes", "outcome")
    packed = frames.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("frames"))
    agree = F.transform("frames", lambda a: F.transform("frames", lambda b: (a["outcome"] == b["outcome"]) | values_match(a["outcome"], b["outcome"])))
    packed = packed.withColumn("agree", agree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *region) for k, own, same in zip(b[key], b["frames"], b["agree"]) for region in every_region(list(own), [[bool(x) for x in r] for r in same])]
            yield pd.DataFrame(rows, columns=[key, "inside", "governing", "outcome", "status"])

    return packed.mapInPandas(run, f"{key} {kind}, inside string, governing string, outcome string, status string")


def regions(frames: list[dict], agree: list[list[bool]] | None = None) -> list[tuple]:
    """As ``every_region``, refused for more than ``MOST`` frames."""
    if len(frames) > MOST:
        raise ValueError(f"more than {MOST} frames of one key")
    return every_region(frames, agree)


def every_region(frames: list[dict], agree: list[list[bool]] | None = None) -> list[tuple]:
    """(inside, governing, outcome, status) of every frame set aside and of every sign vector that some case satisfies."""
    ids = [f["frame"] for f in frames]
    same = agree or [[a["outcome"] == b["outcome"] for b in frames] for a in frames]
    scopes = [{} if f.get("is_default") else constraints(list(f["attributes"])) or None for f in frames]
    out = [(ids[i], "", frames[i]["outcome"], "indeterminate") for i, s in enumerate(scopes) if s is None]
    dead = [i for i, s in enumerate(scopes) if s is not None and not satisfiable([s], [])]
    out += [(ids[i], "", frames[i]["outcome"], "discarded") for i in dead]
    use = [i for i, s in enumerate(scopes) if s is not None and i not in dead]
    families: dict[str, set] = {}
    for i in use:
        for name, c in scopes[i].items():
            families.setdefault(name, set()).add(c[0])
    mixed = [i for i in use if any(len(families[name]) > 1 for name in scopes[i])]
    out += [(ids[i], "", frames[i]["outcome"], "indeterminate") for i in mixed]
    use = [i for i in use if i not in mixed]
    within = lambda i, j: not satisfiable([scopes[i]], [scopes[j]])
    below = {(i, j) for i in use for j in use if i != j and within(i, j) and not within(j, i)}
    open_signs: list[tuple] = [()]
    while open_signs:
        signs = open_signs.pop()
        inside = [i for i, sign in zip(use, signs) if sign]
        if not satisfiable([scopes[i] for i in inside], [scopes[i] for i, sign in zip(use, signs) if not sign]):
            continue
        if len(signs) < len(use):
            open_signs += [(*signs, False), (*signs, True)]
            continue
        least = [i for i in inside if not any((j, i) in below for j in inside)]
        settled = all(same[least[0]][i] for i in least[1:]) if least else False
        status = "uncovered" if not inside else "assigned" if settled else "contested"
        out.append((" ".join(ids[i] for i in inside), " ".join(ids[i] for i in least), frames[least[0]]["outcome"] if settled else None, status))
    return out
