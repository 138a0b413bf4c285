"""Distribution drift between a baseline and a current table.

Numeric features use the population stability index over baseline quantile
bins, categorical features the chi-square test of homogeneity. All features of a
call share the same passes over the data, and both sides are reduced to counts
before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import chi_square_tail
from tidemark.functions.timefns import as_utc_ntz, micros_to_ntz, ntz_to_micros
from tidemark.operators.quantiles import Edges, count_cuts, cut_table, fit_edges, long_form

# Alert thresholds and the share added to empty bins.
PSI_THRESHOLD = 0.25
CHI_SQUARE_THRESHOLD = 0.05
EPSILON = 1e-6
MIN_EXPECTED = 5

_BASELINE, _CURRENT = 0, 1


def bin_counts(
    baseline: DataFrame,
    current: DataFrame,
    edges: Mapping[str, Edges],
    window: str | None = None,
) -> DataFrame:
    """(feature, bin, baseline, current) counts; bin -1 is out of range. With
    ``window``, rows of the baseline have a null window."""
    by = [window] if window else []
    no_window = [F.lit(None).cast(current.schema[w].dataType).alias(w) for w in by]
    here = [F.col(w) for w in by]
    columns = list(edges)
    sides = long_form(
        baseline, columns, (*no_window, F.lit(_BASELINE).alias("side"))
    ).unionByName(long_form(current, columns, (*here, F.lit(_CURRENT).alias("side"))))
    cuts = cut_table(
        baseline,
        edge={c: e.edges[1:-1] for c, e in edges.items()},
        end={c: (e.edges[0], e.edges[-1]) for c, e in edges.items()},
    )
    # Bins are closed below, the last one on both sides.
    outside = (F.col("value") < F.col("end0")) | (F.col("value") > F.col("end1"))
    index = F.when(outside, -1).otherwise(count_cuts(cuts, "edge", "<="))
    return (
        sides.join(F.broadcast(cuts), "feature")
        .groupBy(*by, "feature", index.alias("bin"))
        .agg(
            F.count_if(F.col("side") == _BASELINE).alias("baseline"),
            F.count_if(F.col("side") == _CURRENT).alias("current"),
        )
    )


def histogram(
    baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = 10
) -> DataFrame:
    """Counts of both sides per baseline quantile bin, empty bins included."""
    edges = fit_edges(baseline, columns, bins)
    if not edges:
        raise ValueError("no baseline value in any of the columns")
    grid = baseline.sparkSession.createDataFrame(
        [(c, i, e.edges[i], e.edges[i + 1]) for c, e in edges.items() for i in range(e.bins)],
        "feature string, bin int, low double, high double",
    )
    counts = bin_counts(baseline, current, edges)
    return grid.join(F.broadcast(counts), ["feature", "bin"], "left").select(
        "feature",
        "bin",
        "low",
        "high",
        F.coalesce("baseline", F.lit(0)).alias("baseline"),
        F.coalesce("current", F.lit(0)).alias("current"),
    )


def psi(
    baseline: DataFrame,
    current: DataFrame,
    columns: list[str],
    bins: int = 10,
    threshold: float = PSI_THRESHOLD,
    window: str | None = None,
    edges: Mapping[str, Edges] | None = None,
) -> DataFrame:
    """Population stability index, one row per feature.

    Values outside the baseline's range count on neither side. A feature with an
    empty side has statistic 0. ``edges`` reuses bins fitted earlier (a baseline
    kept with a model); ``window`` compares every value of that column of the
    current side with the baseline separately.
    """
    if edges is None:
        edges = fit_edges(baseline, columns, bins)
    fitted = {c: edges[c] for c in columns if c in edges}
    pairs = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(fitted[c].bins if c in fitted else bins).alias("fit"),
                )
                for c in columns
            ]
        )
    )
    if window:
        by = [window, "feature"]
        windows = current.select(window).filter(F.col(window).isNotNull()).distinct()
        asked = windows.select(window, pairs)
    else:
        by = ["feature"]
        asked = baseline.sparkSession.range(1).select(pairs)
    if fitted:
        counts = bin_counts(baseline, current, fitted, window)
        if window:
            counts = _against_baseline(counts, asked, window)
        asked = asked.join(_psi_of_counts(counts, by), by, "left")
    else:
        asked = asked.withColumns({"psi": F.lit(0.0), "both": F.lit(False)})
    both = F.coalesce(F.col("both"), F.lit(False))
    return asked.select(
        *by,
        F.when(both, F.col("psi")).otherwise(F.lit(0.0)).alias("statistic"),
        F.lit(threshold).alias("threshold"),
        (both & (F.col("psi") >= threshold)).alias("drifted"),
        F.lit("psi").alias("method"),
        F.when(both, F.col("fit")).otherwise(F.lit(bins)).alias("bins"),
    )


def _psi_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., psi, both) from one row per bin; ``both`` tells whether each side had
    any value."""
    whole = W.partitionBy(*by)
    inside = F.col("bin") >= 0

    def share(side: str) -> Column:
        total = F.sum(F.when(inside, F.col(side)).otherwise(F.lit(0))).over(whole)
        return F.col(side) / F.greatest(total, F.lit(1)).cast("double") + F.lit(EPSILON)

    term = (F.col("c") - F.col("b")) * F.ln(F.col("c") / F.col("b"))
    return (
        counts.withColumns({"b": share("baseline"), "c": share("current")})
        .groupBy(*by)
        .agg(
            F.sum(F.when(inside, term).otherwise(F.lit(0.0))).alias("psi"),
            ((F.sum("baseline") > 0) & (F.sum("current") > 0)).alias("both"),
        )
    )


def _against_baseline(counts: DataFrame, asked: DataFrame, window: str) -> DataFrame:
    """Give every window the baseline's counts (one row per feature and bin)."""
    base = counts.filter(F.col(window).isNull() & (F.col("baseline") > 0))
    base = base.select("feature", "bin", "baseline")
    now = counts.filter(F.col(window).isNotNull()).select(window, "feature", "bin", "current")
    bins = F.explode(F.sequence(F.lit(-1), F.col("fit") - 1)).alias("bin")
    return (
        asked.select(window, "feature", bins)
        .join(F.broadcast(base), ["feature", "bin"], "left")
        .join(now, [window, "feature", "bin"], "left")
        .na.fill(0, ["baseline", "current"])
    )


#: Columns of pane histograms: where a pane starts (microseconds), and its counts.
PANE = "pane"


def pane_width(size: int, slide: int) -> int:
    """Seconds of the panes that windows of ``size``, one every ``slide``, are made of."""
    if size <= 0 or slide <= 0:
        raise ValueError("a window and its slide last some seconds")
    return math.gcd(size, slide)


def pane_histograms(
    current: DataFrame, edges: Mapping[str, Edges], ts: str, width: int
) -> DataFrame:
    """(pane, feature, bin, current): each row is binned once, in the pane of ``width`` seconds
    that it falls into. Histograms of different tables or days merge by adding counts, so
    they can be kept and summed over any windows made of whole panes."""
    micros = ntz_to_micros(as_utc_ntz(F.col(ts), current.schema[ts].dataType))
    step = width * 1_000_000
    panes = current.filter(F.col(ts).isNotNull()).withColumn(PANE, micros - F.pmod(micros, F.lit(step)))
    nothing = current.sparkSession.createDataFrame([], panes.schema)
    return bin_counts(nothing, panes, edges, PANE).select(PANE, "feature", "bin", "current")


def merge_panes(*parts: DataFrame) -> DataFrame:
    """Pane histograms of several tables in one."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(PANE, "feature", "bin").agg(F.sum("current").alias("current"))


def window_counts(panes: DataFrame, size: int, slide: int) -> DataFrame:
    """(start, feature, bin, current) of windows of ``size`` seconds that start every
    ``slide`` seconds: a pane's few rows go to the size / slide windows that hold it."""
    whole, step = size * 1_000_000, slide * 1_000_000
    newest = F.col(PANE) - F.pmod(F.col(PANE), F.lit(step))
    oldest = F.floor((F.col(PANE) - F.lit(whole)) / F.lit(step)).cast("bigint") * F.lit(step) + F.lit(step)
    # With gaps between the windows, a pane can lie in none.
    starts = F.when(oldest <= newest, F.sequence(oldest, newest, F.lit(step)))
    held = panes.select(F.explode(starts).alias("start"), "feature", "bin", "current")
    return held.groupBy("start", "feature", "bin").agg(F.sum("current").alias("current"))


def sliding_psi(
    baseline: DataFrame,
    current: DataFrame,
    columns: list[str],
    ts: str,
    size: int,
    slide: int,
    bins: int = 10,
    threshold: float = PSI_THRESHOLD,
    edges: Mapping[str, Edges] | None = None,
    panes: DataFrame | None = None,
) -> DataFrame:
    """Population stability index of overlapping windows of the current side against one
    baseline: (window_start, window_end) and the columns of ``psi``.

    ``size`` and ``slide`` are seconds; windows start at multiples of ``slide`` since 1970 and
    are there if they hold a value of any column. ``panes`` are histograms kept from
    earlier (with the same edges); they are added to those of ``current``.
    """
    if edges is None:
        edges = fit_edges(baseline, columns, bins)
    fitted = {c: edges[c] for c in columns if c in edges}
    if not fitted:
        raise ValueError("no baseline value in any of the columns")
    width = pane_width(size, slide)
    own = pane_histograms(current, fitted, ts, width)
    merged = own if panes is None else merge_panes(own, panes)
    now = window_counts(merged, size, slide)
    nothing = current.sparkSession.createDataFrame([], current.schema)
    base = bin_counts(baseline, nothing, fitted).select(F.lit(None).cast("bigint").alias("start"), "feature", "bin", "baseline", F.lit(0).cast("bigint").alias("current"))
    counts = base.unionByName(now.select("start", "feature", "bin", F.lit(0).cast("bigint").alias("baseline"), "current"))
    fits = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(fitted[c].bins if c in fitted else bins).alias("fit")) for c in columns]))
    asked = now.select("start").distinct().select("start", fits)
    found = asked.join(_psi_of_counts(_against_baseline(counts, asked, "start"), ["start", "feature"]), ["start", "feature"], "left")
    both = F.coalesce(F.col("both"), F.lit(False))
    return found.select(
        micros_to_ntz(F.col("start")).alias("window_start"),
        micros_to_ntz(F.col("start") + F.lit(size * 1_000_000)).alias("window_end"),
        "feature",
        F.when(both, F.col("psi")).otherwise(F.lit(0.0)).alias("statistic"),
        F.lit(threshold).alias("threshold"),
        (both & (F.col("psi") >= threshold)).alias("drifted"),
        F.lit("psi").alias("method"),
        F.when(both, F.col("fit")).otherwise(F.lit(bins)).alias("bins"),
    )


def category_counts(
    baseline: DataFrame,
    current: DataFrame,
    columns: list[str],
) -> DataFrame:
    """(feature, category, baseline, current) over the categories of either side.

    Null is a category of its own.
    """
    pairs = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
                for c in columns
            ]
        )
    )
    rows = baseline.select(F.lit(_BASELINE).alias("side"), pairs).unionByName(
        current.select(F.lit(_CURRENT).alias("side"), pairs)
    )
    return rows.groupBy("feature", "category").agg(
        F.count_if(F.col("side") == _BASELINE).alias("baseline"),
        F.count_if(F.col("side") == _CURRENT).alias("current"),
    )


def chi_square(
    baseline: DataFrame,
    current: DataFrame,
    columns: list[str],
    threshold: float = CHI_SQUARE_THRESHOLD,
) -> DataFrame:
    """Chi-square test of homogeneity; ``statistic`` is the p-value.

    ``low_counts`` warns of expected counts below five. With an empty side the
    p-value is 1.
    """
    counts = category_counts(baseline, current, columns)
    totals = counts.groupBy("feature").agg(
        F.sum("baseline").cast("double").alias("n_baseline"),
        F.sum("current").cast("double").alias("n_current"),
    )
    seen = F.col("baseline") + F.col("current")
    n = F.col("n_baseline") + F.col("n_current")

    def expected(side: str) -> Column:
        return seen * F.col(f"n_{side}") / n

    def cell(side: str) -> Column:
        e = expected(side)
        return F.pow(F.col(side) - e, 2) / F.greatest(e, F.lit(1e-9))

    tested = (
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(
            F.sum(cell("baseline") + cell("current")).alias("chi2"),
            F.count(F.lit(1)).alias("categories"),
            F.min(F.least(expected("baseline"), expected("current"))).alias("expected"),
        )
    )
    chi2 = F.coalesce(F.col("chi2"), F.lit(0.0))
    dof = F.greatest(F.coalesce(F.col("categories"), F.lit(0)) - 1, F.lit(1)).cast("double")
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature")
    return (
        baseline.sparkSession.range(1)
        .select(names)
        .join(F.broadcast(tested), "feature", "left")
        .select(
            "feature",
            chi_square_tail(chi2, dof).alias("statistic"),
            F.coalesce(F.col("expected") < MIN_EXPECTED, F.lit(False)).alias("low_counts"),
        )
        .select(
            "feature",
            "statistic",
            F.lit(threshold).alias("threshold"),
            (F.col("statistic") < threshold).alias("drifted"),
            F.lit("chi_square").alias("method"),
            "low_counts",
        )
    )


def drift_report(
    baseline: DataFrame,
    current: DataFrame,
    numeric: list[str],
    categorical: list[str],
    bins: int = 10,
    psi_threshold: float = PSI_THRESHOLD,
    chi_square_threshold: float = CHI_SQUARE_THRESHOLD,
) -> DataFrame:
    """One row per feature of either kind, ready for an alerting table."""
    columns = ["feature", "method", "statistic", "threshold", "drifted"]
    parts = []
    if numeric:
        parts.append(psi(baseline, current, numeric, bins, psi_threshold).select(*columns))
    if categorical:
        parts.append(
            chi_square(baseline, current, categorical, chi_square_threshold).select(*columns)
        )
    if not parts:
        raise ValueError("name at least one column")
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
