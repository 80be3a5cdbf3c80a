"""Matching of answers and branches: outcome equivalence, one-to-one alignment and the conditional answer score."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import outcomes as O
from quernstone.functions import text as T

SIMILAR, HELD, CORE = 0.45, 0.6, 0.6
MOST = 5
# Words without content in an outcome, words that negate it, bounds that only look like negations.
EMPTY_WORDS = "the a an is are of to for in on and or be that this it with any all".split()
NEGATORS = "no not never cannot neither nor without non nothing none".split()
BOUND = r"(?i)\b(?:no|not)\s+(?:more|less|fewer|later|earlier|sooner|longer)\s+than\b"
NUMBER = r"(\d+(?:[.,]\d+)?\s*%?)"


def outcome_tokens(text: Column) -> Column:
    """Distinct words with content."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*EMPTY_WORDS)))


def numbers(text: Column) -> Column:
    """Distinct figures, spelled ones too."""
    low = O.spelled_to_digits(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(NUMBER), F.lit(1)), lambda x: F.rtrim(x)))


def similarity(a: Column, b: Column) -> Column:
    return T.jaccard(outcome_tokens(a), outcome_tokens(b))


def figures_conflict(a: Column, b: Column) -> Column:
    """Both texts have figures and share none."""
    fa, fb = numbers(a), numbers(b)
    return (F.size(fa) > 0) & (F.size(fb) > 0) & ~F.arrays_overlap(fa, fb)


def polarity_conflict(a: Column, b: Column) -> Column:
    """One text negates and the other does not (by the parity of its negators), about much the same."""
    ta, tb = (outcome_tokens(F.regexp_replace(F.coalesce(x, F.lit("")), BOUND, " ")) for x in (a, b))
    negators = F.array(*map(F.lit, NEGATORS))
    odd = lambda t: F.size(F.array_intersect(t, negators)) % 2
    ca, cb = F.array_except(ta, negators), F.array_except(tb, negators)
    least = F.least(F.size(ca), F.size(cb))
    return (odd(ta) != odd(tb)) & (least > 0) & (F.size(F.array_intersect(ca, cb)) >= CORE * least)


def outcomes_match(gold: Column, predicted: Column) -> Column:
    """Two outcomes say the same: no clash of figures or polarity, and enough words in common; null matches nothing."""
    alike = (similarity(gold, predicted) >= SIMILAR) | (T.containment(outcome_tokens(gold), outcome_tokens(predicted)) >= HELD)
    return ~figures_conflict(gold, predicted) & ~polarity_conflict(gold, predicted) & alike


def values_match(gold: Column, predicted: Column) -> Column:
    """As ``outcomes_match`` of the common forms; figures that count the same thing must agree. Blank matches nothing."""
    g, p = O.canonical_outcome(gold), O.canonical_outcome(predicted)
    said = (F.trim(F.coalesce(gold, F.lit(""))) != "") & (F.trim(F.coalesce(predicted, F.lit(""))) != "")
    return said & ~O.counts_conflict(O.counted_figures(g), O.counted_figures(p)) & outcomes_match(g, p)


def greedy_alignment(pairs: DataFrame, key: str, a: str, b: str, score: str, least: float) -> DataFrame:
    """One-to-one matches (key, a, b, score) of scored pairs, best first, ties by a then b. A key has few pairs."""
    kept = pairs.where(F.col(score) >= least).select(key, a, b, score)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, a, b], ascending=[False, True, True])
        seen_a, seen_b, rows = set(), set(), []
        for r in pdf.itertuples(index=False):
            d = r._asdict()
            if d[a] not in seen_a and d[b] not in seen_b:
                seen_a.add(d[a])
                seen_b.add(d[b])
                rows.append(d)
        return pd.DataFrame(rows, columns=[key, a, b, score])

    return kept.groupBy(key).applyInPandas(run, kept.schema)


def _tokens(s: str) -> list[str]:
    keep = "".join(ch if ch.isalnum() or ch.isspace() else "" for ch in s.lower())
    return [w for w in keep.split() if w not in ("a", "an", "the")]


def _f1(a: list, b: list) -> float:
    if not a or not b:
        return float(a == b)
    common = sum((Counter(a) & Counter(b)).values())
    return 2 * common / (len(a) + len(b))


def conditional_score(predicted: list[tuple[str, list[str]]], gold: list[tuple[str, list[str]]]) -> tuple[float, float, float, float]:
    """(EM, EM with conditions, F1, F1 with conditions): the best assignment of the first five answers, as the reference
    gives no more to its scorer, to all gold ones; answers too
    many cost exp(1 - given / gold); a condition where gold has none makes the conditional score 0."""
    predicted = predicted[:MOST]
    if not gold:
        return (float(not predicted),) * 4
    if not predicted:
        return (0.0,) * 4
    n = len(gold)
    cell = {}
    for i, (p, pc) in enumerate(predicted):
        for j, (g, gc) in enumerate(gold):
            em, f1, c = float(_tokens(p) == _tokens(g)), _f1(_tokens(p), _tokens(g)), _f1(sorted(set(pc)), sorted(set(gc)))
            cell[i, j] = (em, em * c, f1, f1 * c)
    best = []
    for k in range(4):
        most = [0.0] * (1 << len(predicted))  # the best sum of each set of given answers with the gold ones so far
        for j in range(n):
            most = [max([x] + [most[s ^ (1 << i)] + cell[i, j][k] for i in range(len(predicted)) if s >> i & 1]) for s, x in enumerate(most)]
        best.append(max(most) / n)
    cost = math.exp(1 - len(predicted) / n) if len(predicted) > n else 1.0
    return tuple(x * cost for x in best)


def scored_answers(cells: DataFrame, key: str) -> DataFrame:
    """``cells`` (key, answers, gold: arrays of (answer, conditions)) to (key, em, em_conditions, f1, f1_conditions)."""

    def pairs(x) -> list[tuple[str, list[str]]]:
        return [] if x is None else [(a["answer"] or "", list(a["conditions"]) if a["conditions"] is not None else []) for a in x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [conditional_score(pairs(p), pairs(g)) for p, g in zip(b["answers"], b["gold"])]
            yield pd.DataFrame(s, columns=["em", "em_conditions", "f1", "f1_conditions"]).assign(**{key: b[key].to_numpy()})[[key, "em", "em_conditions", "f1", "f1_conditions"]]

    return cells.select(key, "answers", "gold").mapInPandas(run, f"{key} {dict(cells.dtypes)[key]}, em double, em_conditions double, f1 double, f1_conditions double")
