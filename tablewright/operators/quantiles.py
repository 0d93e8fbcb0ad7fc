"""Exact order statistics that scale: sketch a bracket, then count inside it.

The built-in ``percentile`` keeps every distinct value of a column in one
buffer.  Here each pass is a plain aggregate with a bounded buffer: a
quantile sketch proposes two values around the wanted rank, exact counts say
on which side the rank lies, and the open interval between them shrinks by
orders of magnitude per pass until its few remaining values can be listed.
All columns and ranks share the passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .rows import aggregate_row

SKETCH_ACCURACY = 2_000          # rank error n / 2000, the documented bound
LIST_LIMIT = 20_000              # values listed for the last step


@dataclass
class _Target:
    key: tuple
    name: str
    rank: int                    # zero-based rank among non-null values
    below: int = 0               # rows known to lie at or under the open bracket
    inside: int = 0              # rows strictly inside the bracket
    lo: object = None            # open bracket; None is unbounded
    hi: object = None
    value: object = None
    done: bool = False
    stalled: bool = False        # the sketch cut nothing off: halve the value range


def _inside(c: Column, t: _Target) -> Column:
    cond = c.isNotNull()
    if t.lo is not None:
        cond = cond & (c > F.lit(t.lo))
    if t.hi is not None:
        cond = cond & (c < F.lit(t.hi))
    return F.when(cond, c)


def order_statistics(df: DataFrame, columns: Mapping[str, Column],
                     ranks: Mapping[str, Sequence[int]], counts: Mapping[str, int]) -> dict:
    """Values at zero-based ranks: {(name, rank): value}.

    ``columns`` maps names to orderable numeric expressions without NaN and
    ``counts`` gives their non-null counts.
    """
    targets = [_Target((n, r), n, r, inside=counts[n])
               for n, rs in ranks.items() for r in sorted(set(rs))]
    while True:
        open_targets = [t for t in targets if not t.done]
        if not open_targets:
            return {t.key: t.value for t in targets}
        _narrow(df, columns, open_targets)


def _narrow(df: DataFrame, columns: Mapping[str, Column], targets: list[_Target]) -> None:
    """One round: list short brackets, cut long ones with a sketch and counts."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.name, t.lo, t.hi), []).append(t)

    aggregates, plan = [], []
    for g, members in enumerate(groups.values()):
        first = members[0]
        values = _inside(columns[first.name], first)
        if first.inside <= LIST_LIMIT:
            aggregates.append(F.array_sort(F.collect_list(values)).alias(f"g{g}"))
            plan.append((g, members, "list"))
        elif any(t.stalled for t in members):
            aggregates.append(F.array(F.min(values), F.max(values)).alias(f"g{g}"))
            plan.append((g, members, "halve"))
        else:
            slack = 2.0 / SKETCH_ACCURACY
            probs = []
            for t in members:
                at = (t.rank - t.below + 0.5) / first.inside
                probs += [max(0.0, at - slack), min(1.0, at + slack)]
            aggregates.append(F.approx_percentile(
                values, [float(p) for p in probs], SKETCH_ACCURACY).alias(f"g{g}"))
            plan.append((g, members, "sketch"))
    row = aggregate_row(df, aggregates)

    cuts = []
    for g, members, how in plan:
        found = row[f"g{g}"]
        for i, t in enumerate(members):
            if how == "list":
                t.value, t.done = found[t.rank - t.below], True
            elif how == "halve":
                # Sketches hold doubles, so whole numbers beyond 2^53 may fall
                # between two of their values.
                mid = found[0] + (found[1] - found[0]) // 2
                cuts.append((t, mid, mid))
            else:
                cuts.append((t, found[2 * i], found[2 * i + 1]))
    if not cuts:
        return

    counting = []
    for i, (t, a, b) in enumerate(cuts):
        c = _inside(columns[t.name], t)
        counting += [F.count_if(c < F.lit(a)).alias(f"lt{i}"),
                     F.count_if(c == F.lit(a)).alias(f"ea{i}"),
                     F.count_if((c > F.lit(a)) & (c < F.lit(b))).alias(f"in{i}"),
                     F.count_if(c == F.lit(b)).alias(f"eb{i}")]
    n = aggregate_row(df, counting)
    for i, (t, a, b) in enumerate(cuts):
        size = t.inside
        _place(t, a, b, n[f"lt{i}"], n[f"ea{i}"], n[f"in{i}"], n[f"eb{i}"])
        t.stalled = not t.done and t.inside == size


def _place(t: _Target, a, b, lt: int, ea: int, between: int, eb: int) -> None:
    """Use the exact counts to keep only the part that holds the rank."""
    if a == b:
        between, eb = 0, 0
    # A rounded sketch value may lie outside the bracket; it must not widen it.
    raised = a if t.lo is None else max(t.lo, a)
    lowered = b if t.hi is None else min(t.hi, b)
    at = t.rank - t.below
    if at < lt:
        t.hi, t.inside = (a if t.hi is None else min(t.hi, a)), lt
    elif at < lt + ea:
        t.value, t.done = a, True
    elif at < lt + ea + between:
        t.lo, t.hi = raised, lowered
        t.below, t.inside = t.below + lt + ea, between
    elif at < lt + ea + between + eb:
        t.value, t.done = b, True
    else:
        passed = lt + ea + between + eb
        t.lo = b if t.lo is None else max(t.lo, b)
        t.below, t.inside = t.below + passed, t.inside - passed


def quantiles(df: DataFrame, columns: Mapping[str, Column], qs: Sequence[float],
              counts: Mapping[str, int], exact_rows: int) -> dict[str, list]:
    """Linearly interpolated quantiles per column, None for empty columns.

    Short columns use the built-in aggregate, whose buffer is then bounded by
    ``exact_rows``; longer ones use order statistics.
    """
    out: dict[str, list] = {n: [None] * len(qs) for n in columns}
    small = [n for n in columns if 0 < counts[n] <= exact_rows]
    large = [n for n in columns if counts[n] > exact_rows]
    if small:
        row = aggregate_row(df, [F.percentile(columns[n], [float(q) for q in qs]).alias(f"p{i}")
                                 for i, n in enumerate(small)])
        for i, n in enumerate(small):
            out[n] = [None if v is None else float(v) for v in row[f"p{i}"]]
    if large:
        ranks = {}
        for n in large:
            ranks[n] = [f(q * (counts[n] - 1)) for q in qs for f in (math.floor, math.ceil)]
        values = order_statistics(df, {n: columns[n] for n in large}, ranks, counts)
        for n in large:
            for k, q in enumerate(qs):
                pos = q * (counts[n] - 1)
                lo, hi = math.floor(pos), math.ceil(pos)
                a, b = float(values[n, lo]), float(values[n, hi])
                # Same arithmetic as the built-in aggregate.
                out[n][k] = a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b
    return out
