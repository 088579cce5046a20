"""Exact quantiles of many columns at any size, without moving the data.

A sketch brackets every wanted order statistic, a counting pass says where in the bracket it
lies, and a last pass fetches it. Each pass is one aggregate over the numeric columns; only a few
numbers per column and the values of the last, small brackets reach the driver. Tables of all
sizes go this way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000
FETCH = 200_000       # open brackets are fetched once they hold no more values than this together
COLUMNS_PER_PASS = 16 # more columns are done in turn, so a task holds the sketches of a few only


@dataclass
class _Target:
    """One order statistic: rank ``rank`` (from 0) among the values inside (low, high)."""
    rank: int
    low: float | None = None      # values at or below are ruled out
    high: float | None = None     # values at or above are ruled out
    below: int = 0                # how many values are at or below ``low``
    inside: int = 0
    value: float | None = None
    bracket: tuple = field(default=())


def _within(c: Column, t: _Target) -> Column:
    keep = c.isNotNull()
    if t.low is not None:
        keep = keep & (c > t.low)
    if t.high is not None:
        keep = keep & (c < t.high)
    return keep


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float],
                    fetch: int = FETCH, accuracy: int = ACCURACY,
                    raw: dict[str, Column] | None = None) -> dict[str, dict]:
    """{name: {"count": n, "quantiles": [...], "mean": m, "std": s, "min": a, "max": b}}.

    Quantiles are interpolated linearly. ``std`` is the population deviation. ``min`` and ``max``
    have the type of the column in ``raw``, by default that in ``columns``. Columns without a value
    have ``quantiles`` None.
    """
    if not columns:
        return {}
    if len(columns) > COLUMNS_PER_PASS:
        names, out = list(columns), {}
        for start in range(0, len(names), COLUMNS_PER_PASS):
            part = {n: columns[n] for n in names[start:start + COLUMNS_PER_PASS]}
            out |= exact_quantiles(df, part, probabilities, fetch, accuracy, raw)
        return out
    names, raw = list(columns), raw or columns
    row = df.agg(*[a for i, n in enumerate(names) for a in (
        F.count(columns[n]).alias(f"n{i}"), F.avg(columns[n]).alias(f"m{i}"),
        F.stddev_pop(columns[n]).alias(f"s{i}"), F.min(raw[n]).alias(f"a{i}"),
        F.max(raw[n]).alias(f"b{i}"))]).first()
    facts = {n: {"count": row[f"n{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"],
                 "min": row[f"a{i}"], "max": row[f"b{i}"], "quantiles": None}
             for i, n in enumerate(names)}
    ranks = {}
    for n in names:
        last = facts[n]["count"] - 1
        if last >= 0:
            wanted = {f(last * p) for p in probabilities for f in (math.floor, math.ceil)}
            ranks[n] = {r: _Target(r, inside=last + 1) for r in wanted}
    _resolve(df, columns, ranks, fetch, accuracy)
    for n, found in ranks.items():
        out = []
        for p in probabilities:
            at = (facts[n]["count"] - 1) * p
            low, high = (found[r].value for r in (math.floor(at), math.ceil(at)))
            out.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        facts[n]["quantiles"] = out
    return facts


def _resolve(df: DataFrame, columns: dict, ranks: dict, fetch: int, accuracy: int) -> None:
    """Narrow every open target until its value is known; the first step is a sketch."""
    sketched = False
    while True:
        todo = [(n, t) for n, ts in ranks.items() for t in ts.values() if t.value is None]
        if not todo:
            return
        near = []
        for n, t in sorted(todo, key=lambda x: x[1].inside):
            if sketched and sum(u.inside for _, u in near) + t.inside <= fetch:
                near.append((n, t))
        sketched = True
        if near:
            open_brackets = {(n, t.low, t.high): t for n, t in near}
            row = df.agg(*[F.sort_array(F.collect_list(
                F.when(_within(columns[n], t), columns[n]))).alias(f"v{i}")
                for i, ((n, _, _), t) in enumerate(open_brackets.items())]).first()
            place = {key: i for i, key in enumerate(open_brackets)}
            for n, t in near:
                t.value = row[f"v{place[n, t.low, t.high]}"][t.rank - t.below]
        wide = [(n, t) for n, t in todo if t.value is None]
        if not wide:
            continue
        # Targets of one column in one interval share a sketch; neighbouring ranks share a bracket.
        sketches: dict[tuple, list[_Target]] = {}
        for n, t in wide:
            sketches.setdefault((n, t.low, t.high), []).append(t)
        aggregates = []
        for i, ((n, _, _), targets) in enumerate(sketches.items()):
            marks = []
            for t in targets:
                cell = math.floor((t.rank - t.below + 0.5) / t.inside * accuracy)
                marks += [max(0.0, (cell - 2) / accuracy), min(1.0, (cell + 3) / accuracy)]
            inside = F.when(_within(columns[n], targets[0]), columns[n])
            aggregates.append(F.percentile_approx(inside, marks, accuracy).alias(f"b{i}"))
        row = df.agg(*aggregates).first()
        for i, targets in enumerate(sketches.values()):
            for k, t in enumerate(targets):
                t.bracket = tuple(row[f"b{i}"][2 * k:2 * k + 2])
        brackets = list(dict.fromkeys((n, *t.bracket) for n, t in wide))
        row = df.agg(*[a for i, (n, low, high) in enumerate(brackets) for a in (
            F.count_if(columns[n] < low).alias(f"lt{i}"), F.count_if(columns[n] <= low).alias(f"le{i}"),
            F.count_if(columns[n] < high).alias(f"ht{i}"),
            F.count_if(columns[n] <= high).alias(f"he{i}"))]).first()
        for n, t in wide:
            i = brackets.index((n, *t.bracket))
            low, high = t.bracket
            under_low, upto_low = row[f"lt{i}"], row[f"le{i}"]
            under_high, upto_high = row[f"ht{i}"], row[f"he{i}"]
            if t.rank < under_low:                      # the sketch was off: keep the part below
                t.inside = under_low - t.below
                t.high = low
            elif t.rank < upto_low:
                t.value = low
            elif t.rank < under_high:
                t.low, t.high, t.below, t.inside = low, high, upto_low, under_high - upto_low
            elif t.rank < upto_high:
                t.value = high
            else:                                       # keep the part above
                t.inside -= upto_high - t.below
                t.low, t.below = high, upto_high
