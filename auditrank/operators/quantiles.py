"""Exact quantiles of many columns, interpolated or discrete, in three passes over the table.

The built-in exact ``percentile`` keeps every distinct value of a column in one
task.  Here one wide aggregate takes a sketch of every column, which brackets each
wanted rank; a second one counts the rows around all brackets; and the values
strictly inside a bracket, a share of about ``2 / GRID`` of the rows, are put in
order.  The counts prove that the wanted ranks lie in the bracket; where they do
not, the bracket becomes the whole column, so the result is exact in every case.

The rows are never stacked: a row leaves the third pass only with the few of its
values that fall into a bracket.  Equal values are folded to one row with a number
before the shuffle.  A bracket with few rows is ordered by a window; one with more
than ONE_TASK is laid out in ranges (:func:`_by_ranges`), so no task holds a column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditrank.functions.columns import NUMERIC
from auditrank.session import stage

#: A value of a column: all columns of a call are doubles, or all are NUMERIC.
Value = float | Decimal
#: {column: {probability: value or None}}
Quantiles = dict[str, dict[float, float | None]]
#: Wanted 0-based ranks among a column's values, from their number and that of NULLs.
RanksOf = Callable[[int, int], Iterable[int]]

#: Points at which each sketch is read.
GRID = 1_000
#: Rows of a bracket that a window may order in one task.
ONE_TASK = 1_000_000
_PLACE_BITS = 33  # monotonically_increasing_id: partition above, row below


# Hundreds of expressions are built here; as SQL text each takes one call to the JVM.
def _name(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _literal(value: Value) -> str:
    if isinstance(value, Decimal):
        return f"CAST('{value:f}' AS {NUMERIC})"
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


@dataclass
class _Bracket:
    """Ranks of one column between two values; both None for the whole column."""

    column: str
    ranks: list[int]
    low: Value | None
    high: Value | None
    at_low: int = 0  # rows up to and including ``low``
    inside: int = 0  # rows strictly between

    def holds(self) -> str:
        v = _name(self.column)
        return f"{v} IS NOT NULL" if self.low is None else f"{v} > {_literal(self.low)} AND {v} < {_literal(self.high)}"

    def offsets(self) -> list[int]:
        return [r - self.at_low for r in self.ranks]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000
) -> Quantiles:
    """Quantiles of double columns, NULLs ignored, linear between ranks.

    Runs jobs; a few numbers per column and probability reach the driver.
    """
    found, counts = order_statistics(
        df, columns, lambda n, _: {r for p in probabilities if n for r in _neighbours(p, n)[:2]}, accuracy
    )
    return {
        c: {p: interpolated(p, counts[c][0], found[c].__getitem__) if counts[c][0] else None for p in probabilities}
        for c in columns
    }


def discrete_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000
) -> dict[str, dict[float, Value | None]]:
    """Smallest values that at least the given shares of the values do not exceed.

    NULLs are ignored; the columns are doubles or NUMERIC.  ``accuracy`` is that of the
    sketch and sets how many rows are put in order, not how exact the result is.
    """

    def rank(probability: float, n: int) -> int:
        return max(1, math.ceil(Fraction(str(probability)) * n)) - 1

    found, counts = order_statistics(df, columns, lambda n, _: {rank(p, n) for p in probabilities if n}, accuracy)
    return {
        c: {p: found[c][rank(p, counts[c][0])] if counts[c][0] else None for p in probabilities} for c in columns
    }


def filled_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000
) -> tuple[dict[str, float | None], Quantiles]:
    """Medians, and quantiles of the columns with their gaps filled by the median.

    Filled gaps are so many rows with the median's value, put in behind the lower half;
    which ranks they move, and how far, follows from their number.  So the same passes
    give both.
    """

    def rank_among_values(rank: int, n: int, gaps: int) -> int | None:
        """None for a filled gap."""
        lower_half = (n + 1) // 2
        if rank < lower_half:
            return rank
        return None if rank < lower_half + gaps else rank - gaps

    def ranks(n: int, gaps: int) -> set[int]:
        if not n:
            return set()
        filled = {rank_among_values(r, n, gaps) for p in probabilities for r in _neighbours(p, n + gaps)[:2]}
        return {*_neighbours(0.5, n)[:2], *filled} - {None}

    found, counts = order_statistics(df, columns, ranks, accuracy)
    medians: dict[str, float | None] = {}
    quantiles: Quantiles = {}
    for c in columns:
        n, gaps = counts[c]
        medians[c] = median = interpolated(0.5, n, found[c].__getitem__) if n else None

        def value(rank: int) -> float:
            own = rank_among_values(rank, n, gaps)
            return median if own is None else found[c][own]

        quantiles[c] = {p: interpolated(p, n + gaps, value) if n else None for p in probabilities}
    return medians, quantiles


def _neighbours(probability: float, n: int) -> tuple[int, int, float]:
    """Ranks between which a quantile of ``n`` rows lies, and the share of the upper one."""
    place = probability * (n - 1)
    return math.floor(place), math.ceil(place), place - math.floor(place)


def interpolated(probability: float, n: int, value: Callable[[int], float]) -> float:
    below, above, weight = _neighbours(probability, n)
    lower, upper = value(below), value(above)
    return lower + (upper - lower) * weight


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks_of: RanksOf, accuracy: int = 10_000
) -> tuple[dict[str, dict[int, Value]], dict[str, tuple[int, int]]]:
    """Values at the wanted ranks of each column, and its numbers of values and NULLs."""
    found: dict[str, dict[int, Value]] = {c: {} for c in columns}
    if not columns:
        return found, {}
    counts, edges = _sketched(df, columns, accuracy)
    brackets = [
        b for c in columns for b in _bracketed(c, sorted(ranks_of(*counts[c])), counts[c][0], edges[c])
    ]
    missed = _settled(df, brackets, found)
    # Where the sketch was wrong, the whole column is the bracket.
    again = {}
    for b in missed:
        again.setdefault(b.column, _Bracket(b.column, [], None, None, 0, counts[b.column][0])).ranks.extend(b.ranks)
    waiting = [b for b in brackets if b.ranks and b not in missed] + list(again.values())
    for some, order in (
        ([b for b in waiting if b.inside <= ONE_TASK], _by_window),
        ([b for b in waiting if b.inside > ONE_TASK], _by_ranges),
    ):
        if some:
            for (t, offset), value in order(_inside(df, some), [b.offsets() for b in some]).items():
                found[some[t].column][offset + some[t].at_low] = value
    return found, counts


def _sketched(
    df: DataFrame, columns: Sequence[str], accuracy: int
) -> tuple[dict[str, tuple[int, int]], dict[str, list[Value]]]:
    """Numbers of values and NULLs, and the sketch read at GRID + 1 points, per column."""
    points = F.lit(np.arange(GRID + 1) / GRID)  # one literal, not GRID expressions per column
    row = df.agg(
        F.count("*"),
        *(F.struct(F.count(c), F.percentile_approx(c, points, accuracy)).alias(f"c{i}") for i, c in enumerate(columns)),
    ).first()
    counts = {c: (row[i][0], row[0] - row[i][0]) for i, c in enumerate(columns, 1)}
    return counts, {c: row[i][1] for i, c in enumerate(columns, 1)}


def _bracketed(column: str, ranks: list[int], n: int, edges: list[Value]) -> list[_Bracket]:
    """A bracket for each run of ranks with the same points of the sketch around them."""
    brackets: list[_Bracket] = []
    for rank in ranks:
        place = rank / max(1, n - 1) * GRID
        low, high = edges[max(0, math.floor(place) - 1)], edges[min(GRID, math.ceil(place) + 1)]
        if not brackets or (brackets[-1].low, brackets[-1].high) != (low, high):
            brackets.append(_Bracket(column, [], low, high))
        brackets[-1].ranks.append(rank)
    return brackets


def _settled(df: DataFrame, brackets: list[_Bracket], found: dict[str, dict[int, Value]]) -> list[_Bracket]:
    """Counts around all brackets; settles ranks that fall on an edge, leaves in each
    bracket those inside, and returns the brackets that miss a rank."""
    edges = sorted({(b.column, e) for b in brackets for e in (b.low, b.high)})
    if not edges:
        return []
    row = df.agg(
        *(
            F.expr(f"struct(count_if({_name(c)} < {_literal(e)}), count_if({_name(c)} <= {_literal(e)})) AS e{i}")
            for i, (c, e) in enumerate(edges)
        )
    ).first()
    seen = dict(zip(edges, row))
    missed = []
    for b in brackets:
        (below, to_low), (under_high, to_high) = seen[b.column, b.low], seen[b.column, b.high]
        b.at_low, b.inside = to_low, under_high - to_low
        if not below <= b.ranks[0] <= b.ranks[-1] < to_high:
            missed.append(b)
            continue
        for rank in b.ranks:
            if rank < to_low:
                found[b.column][rank] = b.low
            elif rank >= under_high:
                found[b.column][rank] = b.high
        b.ranks = [r for r in b.ranks if to_low <= r < under_high]
    return missed


def _inside(df: DataFrame, brackets: list[_Bracket]) -> DataFrame:
    """(t, v, n): the values inside bracket t, equal ones folded."""
    entries = ", ".join(
        f"CASE WHEN {b.holds()} THEN struct({t} AS t, {_name(b.column)} AS v) END" for t, b in enumerate(brackets)
    )
    own = df.select(F.expr(f"explode(array_compact(array({entries}))) AS own"))
    return own.groupBy("own.t", "own.v").agg(F.count("*").alias("n"))


def _longs(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))


def _hits(placed: DataFrame, part: Column, wanted: Column) -> list:
    """(t, part, v, offset) of rows that hold a wanted offset within t and part."""
    end = F.sum("n").over(Window.partitionBy("t", "part").orderBy("v"))
    rows = placed.select("t", part.alias("part"), "v", "n", wanted.alias("wanted")).withColumn("end", end)
    own = F.filter("wanted", lambda o: (o >= F.col("end") - F.col("n")) & (o < F.col("end")))
    return rows.select("t", "part", "v", F.explode(own).alias("offset")).collect()


def _by_window(values: DataFrame, wanted: list[list[int]]) -> dict[tuple[int, int], Value]:
    offsets = F.array(*map(_longs, wanted))[F.col("t")]
    return {(r.t, r.offset): r.v for r in _hits(values, F.lit(0), offsets)}


def _by_ranges(values: DataFrame, wanted: list[list[int]]) -> dict[tuple[int, int], Value]:
    """Selection by a range layout: the rows of each range are counted, and only the ranges
    that hold a wanted offset are put in order, each by itself."""
    laid_out = stage(
        values.repartitionByRange("t", "v").withColumn("_place", F.monotonically_increasing_id()), "quantile-ranges"
    ).withColumn("_range", F.shiftright("_place", _PLACE_BITS))
    # A range holds neighbouring brackets: at most ranges + brackets rows.
    sizes = laid_out.groupBy("t", "_range").agg(F.sum("n").alias("size")).orderBy("t", "_range").collect()
    start = dict.fromkeys(range(len(wanted)), 0)
    starts: dict[tuple[int, int], int] = {}
    parts = []
    for t, part, size in sizes:
        starts[t, part] = start[t]
        local = [o - start[t] for o in wanted[t] if 0 <= o - start[t] < size]
        if local:
            parts.append((t, part, local))
        start[t] += size
    local = F.coalesce(
        *(F.when((F.col("t") == t) & (F.col("_range") == part), _longs(offsets)) for t, part, offsets in parts)
    )
    chosen = laid_out.withColumn("_wanted", local).where(F.col("_wanted").isNotNull())
    rows = _hits(chosen, F.col("_range"), F.col("_wanted"))
    return {(r.t, r.offset + starts[r.t, r.part]): r.v for r in rows}
