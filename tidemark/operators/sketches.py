"""Quantiles of data too large to rank: mergeable sketches, kept by day.

A KLL sketch of some kilobytes stands for all values of a column in a day. Sketches of
days, tables or retries of a day merge into one for any range, so a range costs its days,
not its rows. A quantile from a sketch of n values has a rank within
``rank_error(k) * n`` of the wanted one, whatever was merged, but for about one in a hundred
cases; ``SURE`` times that is not exceeded in practice. Use ``operators.quantiles`` where
ranks must be exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quantiles import linspace, long_form

#: Size of a sketch: about 3 * K values of 8 bytes are kept.
K = 2_000
SURE = 2.0
DAY = "day"
_SKETCH = "sketch"


def rank_error(k: int = K) -> float:
    """The published one-sided error of a KLL sketch of size k, as a share of all values."""
    return 2.296 / k**0.9021


def sketch_values(df: DataFrame, columns: list[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(by..., feature, n, sketch) of the values that are not null or NaN. Sketches are made in
    each task and merged; values are not shuffled."""
    rows = long_form(df, columns, tuple(F.col(c) for c in by))
    return rows.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias(_SKETCH)
    )


def sketch_days(df: DataFrame, columns: list[str], ts: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(day, by..., feature, n, sketch): a table to keep, one row for each day and column."""
    return sketch_values(df.withColumn(DAY, F.to_date(ts)), columns, (DAY, *by), k)


def merge_sketches(kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, n, sketch) over all rows of ``kept``, whatever they were kept by."""
    return kept.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double(_SKETCH).alias(_SKETCH))


def read_quantiles(merged: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(by..., feature, n, pos, probability, value) of sketches."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.kll_sketch_get_quantile_double(F.col(_SKETCH), wanted)
    rest = [c for c in merged.columns if c != _SKETCH]
    pairs = merged.select(*rest, F.posexplode(F.arrays_zip(wanted.alias("p"), values.alias("v"))).alias("pos", "x"))
    return pairs.select(*rest, "pos", F.col("x.p").alias("probability"), F.col("x.v").alias("value"))


def sketch_edges(kept: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Edges of bins that hold about equally many values: (by..., feature, n, pos, edge). Equal
    edges are one, so a column with few values has fewer bins."""
    found = read_quantiles(merge_sketches(kept, by), linspace(bins))
    edges = found.groupBy(*by, "feature", "n").agg(F.array_sort(F.collect_set("value")).alias("e"))
    return edges.select(*by, "feature", "n", F.posexplode("e").alias("pos", "edge"))


def latency_quantiles(
    kept: DataFrame, probabilities: Sequence[float] = (0.5, 0.9, 0.99), by: Sequence[str] = ("model_name",)
) -> DataFrame:
    """(by..., n, probability, seconds) over the days in ``kept``."""
    found = read_quantiles(merge_sketches(kept, by), probabilities)
    return found.select(*by, "n", "probability", F.col("value").alias("seconds"))


def rank_gaps(exact: DataFrame, asked: DataFrame, column: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """How far asked values are from their wanted ranks, as a share of all values: ``asked``
    (by..., probability, value) with ``gap``. For checking sketches: reads all rows once and
    counts them between the asked values, which are few.

    A value that occurs often has all the ranks it covers; the nearest counts.
    """
    spark, by = exact.sparkSession, list(by)
    rows = asked.collect()  # the asked values
    points: dict[tuple, list[float]] = {}
    for r in rows:
        points.setdefault(tuple(r[c] for c in by), []).append(r[value])
    kinds = [asked.schema[c] for c in by]
    listed = [(*group, sorted(set(v))) for group, v in points.items()]
    schema = T.StructType([*kinds, T.StructField("__p", T.ArrayType(T.DoubleType()))])
    table = F.broadcast(spark.createDataFrame(listed, schema))
    v = F.col(column).cast("double")
    kept = exact.filter(v.isNotNull() & ~F.isnan(v))
    met = kept.join(table, by) if by else kept.withColumn("__p", F.array(*[F.lit(float(x)) for x in listed[0][0]]) if listed else F.array())
    below = F.size(F.filter("__p", lambda p: p < v)).alias("__lt")
    upto = F.size(F.filter("__p", lambda p: p <= v)).alias("__le")
    counts = met.groupBy(*by, below, upto).agg(F.count(F.lit(1)).alias("__n")).collect()  # a few for each point
    out = []
    for r in rows:
        group = tuple(r[c] for c in by)
        own = [c for c in counts if tuple(c[x] for x in by) == group]
        n, i = sum(c["__n"] for c in own), sorted(set(points[group])).index(r[value])
        less, most = sum(c["__n"] for c in own if c["__le"] <= i), sum(c["__n"] for c in own if c["__lt"] <= i)
        rank = r["probability"] * n
        out.append((*r, max(less - rank, rank - most, 0.0) / max(n, 1)))
    return spark.createDataFrame(out, T.StructType([*asked.schema.fields, T.StructField("gap", T.DoubleType())]))
