"""Exact quantile edges of numeric columns, without sorting a column in one task.

Fitting narrows a bracket around every wanted rank. Each pass sketches the values
inside the current brackets and counts everything between them; once a bracket
holds few enough rows, its distinct values are counted one by one and the exact
ranks are read off. A bracket that turns out to miss its rank is narrowed again
with more room, so the result never depends on the sketch. What reaches the
driver is a few numbers per column and bracket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The sketch keeps ranks to 1 / ACCURACY and is read at GRID steps.
ACCURACY = 4_000
GRID = 400

# Rows of one bracket whose distinct values one task sorts in passing.
BRACKET_ROWS = 250_000

# Columns fitted together; a wider table takes several rounds.
COLUMNS_PER_JOB = 64

_EVERYTHING = (float("-inf"), float("inf"))


@dataclass(frozen=True)
class Edges:
    """Bin edges of one column. ``n`` counts the values that are not null or NaN."""

    n: int
    edges: tuple[float, ...]

    @property
    def bins(self) -> int:
        return len(self.edges) - 1


def linspace(bins: int) -> list[float]:
    """Probabilities 0..1 in ``bins`` steps; each is i times the rounded step."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def long_form(df: DataFrame, columns: list[str], keep: tuple[Column, ...] = ()) -> DataFrame:
    """(keep..., feature, value) rows without missing values."""
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ]
    rows = df.select(*keep, F.inline(F.array(*pairs)))
    return rows.filter("value is not null and not isnan(value)")


def cut_table(df: DataFrame, **cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """One row per column with its cuts as scalars ``<kind>0..``, filled up with NaN
    (which sorts after every value). Bounded by the columns of a schema."""
    names, rows = [], {}
    for kind, by_column in cuts.items():
        width = max(len(c) for c in by_column.values())
        names += [f"{kind}{i}" for i in range(width)]
        for column, x in by_column.items():
            rows.setdefault(column, [column]).extend([*x, *[math.nan] * (width - len(x))])
    schema = "feature string" + "".join(f", {n} double" for n in names)
    return df.sparkSession.createDataFrame(list(rows.values()), schema)


def count_cuts(cuts: DataFrame, prefix: str, comparison: str) -> Column:
    """How many of a row's cuts are below ``value``: plain comparisons, no lambdas."""
    names = [c for c in cuts.columns if c.startswith(prefix)]
    total = " + ".join(f"cast({c} {comparison} value as int)" for c in names)
    return F.expr(f"coalesce({total or 0}, 0)")


def fit_edges(
    df: DataFrame,
    columns: list[str],
    bins: int = 10,
    exact: bool = True,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, Edges]:
    """Distinct linear-interpolated quantiles of each column.

    A column whose values are all equal gets ``bins`` equal-width bins over
    ``[min, max + 1e-9]``; a column without values is left out. ``exact=False``
    takes values of a sketch and reads the data once.
    """
    found: dict[str, Edges] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        part = columns[start : start + COLUMNS_PER_JOB]
        if exact:
            found |= _fit(df, part, bins, bracket_rows)
        else:
            found |= _sketched(df, part, bins)
    return found


def quantile_edges(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Fitted edges as rows (feature, n, pos, edge)."""
    fitted = fit_edges(df, columns, bins)
    rows = [(c, e.n, i, x) for c, e in fitted.items() for i, x in enumerate(e.edges)]
    return df.sparkSession.createDataFrame(rows, "feature string, n long, pos int, edge double")


def _sketched(df: DataFrame, columns: list[str], bins: int) -> dict[str, Edges]:
    rows = (
        long_form(df, columns)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.percentile_approx("value", linspace(bins), 10 * ACCURACY).alias("points"),
        )
        .collect()
    )
    return {r.feature: Edges(r.n, _distinct(r.lo, r.points, r.hi, bins)) for r in rows}


def _fit(df: DataFrame, columns: list[str], bins: int, bracket_rows: int) -> dict[str, Edges]:
    inner = linspace(bins)[1:-1]
    brackets = {c: [_EVERYTHING] for c in columns}
    margin = dict.fromkeys(columns, 2.0 / ACCURACY)
    fitted: dict[str, Edges] = {}
    shape: dict[str, tuple[int, float, float]] = {}
    while brackets:
        ready = {}
        for c, segments in _sketch_segments(df, brackets).items():
            if c not in shape:
                lows, highs = [s.lo for s in segments.values()], [s.hi for s in segments.values()]
                shape[c] = (sum(s.n for s in segments.values()), min(lows), max(highs))
            n = shape[c][0]
            ranks = {r for p in inner for r in _neighbours(p, n)}
            narrowed, rows = _narrow(segments, ranks, margin[c], bracket_rows)
            if narrowed is None:
                margin[c] *= 4
                brackets[c] = [_EVERYTHING]
                continue
            # Brackets that stop shrinking are held open by copies of one value, which
            # count as one.
            settled = narrowed == brackets[c]
            brackets[c] = narrowed
            if rows <= bracket_rows or settled or margin[c] >= 1.0:
                ready[c] = (narrowed, sorted(ranks))
        for c in set(brackets) - set(shape):
            del brackets[c]  # no values at all
        if not ready:
            continue
        at = _values_at(
            df, {c: b for c, (b, _) in ready.items()}, {c: r for c, (_, r) in ready.items()}
        )
        for c, (_, ranks) in ready.items():
            n, lo, hi = shape[c]
            if all(r in at[c] for r in ranks):
                points = [_interpolate(p, n, at[c]) for p in inner]
                fitted[c] = Edges(n, _distinct(lo, points, hi, bins))
                del brackets[c]
            else:
                margin[c] *= 4
                brackets[c] = [_EVERYTHING]
    return {c: fitted[c] for c in columns if c in fitted}


@dataclass(frozen=True)
class _Segment:
    n: int
    lo: float
    hi: float
    grid: list[float] | None


def _segmented(df: DataFrame, brackets: Mapping[str, list[tuple[float, float]]]) -> DataFrame:
    """(feature, segment, value): segments alternate, even ones are the gaps between
    brackets, odd ones are brackets."""
    cuts = cut_table(
        df,
        start={c: [start for start, _ in b] for c, b in brackets.items()},
        end={c: [end for _, end in b] for c, b in brackets.items()},
    )
    segment = count_cuts(cuts, "start", "<=") + count_cuts(cuts, "end", "<")
    rows = long_form(df, list(brackets)).join(F.broadcast(cuts), "feature")
    return rows.select("feature", segment.alias("segment"), "value")


def _sketch_segments(
    df: DataFrame, brackets: Mapping[str, list[tuple[float, float]]]
) -> dict[str, dict[int, _Segment]]:
    inside = F.when(F.col("segment") % 2 == 1, F.col("value"))
    rows = (
        _segmented(df, brackets)
        .groupBy("feature", "segment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.percentile_approx(inside, [i / GRID for i in range(GRID + 1)], ACCURACY).alias("q"),
        )
        .collect()
    )
    found: dict[str, dict[int, _Segment]] = {}
    for r in sorted(rows, key=lambda r: r.segment):
        found.setdefault(r.feature, {})[r.segment] = _Segment(r.n, r.lo, r.hi, r.q)
    return found


def _narrow(
    segments: Mapping[int, _Segment], ranks: set[int], margin: float, bracket_rows: int
) -> tuple[list[tuple[float, float]] | None, int]:
    """New brackets for the ranks and the rows the largest is expected to hold;
    ``None`` if a rank lies in a gap. Small brackets are kept as they are."""
    brackets: dict[tuple[float, float], float] = {}
    before = 0
    for number, s in segments.items():
        mine = [r - before for r in ranks if before <= r < before + s.n]
        before += s.n
        if not mine:
            continue
        if number % 2 == 0:
            return None, 0
        for r in mine:
            share = r / max(s.n - 1, 1)
            low = max(math.floor((share - margin) * GRID), 0)
            high = min(math.ceil((share + margin) * GRID), GRID)
            if s.n <= bracket_rows or s.lo == s.hi:
                brackets[s.lo, s.hi] = 0 if s.lo == s.hi else s.n
            else:
                bracket = (s.grid[low] if low else s.lo, s.grid[high] if high < GRID else s.hi)
                alone = bracket[0] == bracket[1]
                brackets[bracket] = 0 if alone else s.n * ((high - low) / GRID + 2 * margin)
    merged: list[list[float]] = []
    for (start, end), rows in sorted(brackets.items()):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
            merged[-1][2] += rows
        else:
            merged.append([start, end, rows])
    largest = max((m[2] for m in merged), default=0)
    return [(start, end) for start, end, _ in merged], largest


def _values_at(
    df: DataFrame,
    brackets: Mapping[str, list[tuple[float, float]]],
    ranks: Mapping[str, list[int]],
) -> dict[str, dict[int, float]]:
    """Values at 0-based ranks, as far as they lie inside the brackets."""
    counted = (
        _segmented(df, brackets)
        .withColumn("value", F.when(F.col("segment") % 2 == 1, F.col("value")))
        .groupBy("feature", "segment", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    running = W.partitionBy("feature", "segment").orderBy("value")
    before = W.partitionBy("feature").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    # Values before each segment: a few rows per column.
    offsets = (
        counted.groupBy("feature", "segment")
        .agg(F.sum("rows").alias("size"))
        .select("feature", "segment", F.sum("size").over(before).alias("offset"))
    )
    asked = df.sparkSession.createDataFrame(
        [(c, r) for c, r in ranks.items()], "feature string, ranks array<long>"
    )
    start = F.col("upto") - F.col("rows")
    covered = F.filter("ranks", lambda r: (r >= start) & (r < F.col("upto")))
    placed = (
        counted.withColumn("inside", F.sum("rows").over(running))
        .join(F.broadcast(offsets), ["feature", "segment"])
        .withColumn("upto", F.col("inside") + F.coalesce("offset", F.lit(0)))
        .join(F.broadcast(asked), "feature")
        .select("feature", F.explode(covered).alias("rank"), "value")
    )
    at: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for feature, rank, value in placed.collect():
        if value is not None:
            at[feature][rank] = value
    return at


def _neighbours(p: float, n: int) -> tuple[int, int]:
    low = math.floor(p * (n - 1))
    return low, min(low + 1, n - 1)


def _interpolate(p: float, n: int, at: dict[int, float]) -> float:
    low, high = _neighbours(p, n)
    t = p * (n - 1) - low
    # From the nearer end, as the usual linear quantile is computed.
    if t < 0.5:
        return at[low] + (at[high] - at[low]) * t
    return at[high] - (at[high] - at[low]) * (1.0 - t)


def _distinct(lo: float, points: list[float], hi: float, bins: int) -> tuple[float, ...]:
    edges = sorted({lo, *points, hi})
    if len(edges) > 1:
        return tuple(edges)
    top = hi + 1e-9
    step = (top - lo) / bins
    return (*[lo + i * step for i in range(bins)], top)
