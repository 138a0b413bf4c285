"""Mix sources to token targets by entropy balancing.

Each document gets the rate nearest, in token-weighted relative entropy, to taking
everything once under the constraint that every level of every margin (a source,
say) meets its token target. The dual of that problem is smooth and convex, with
one multiplier for each level, and the optimum is an exponential tilt: a document's
rate is the exponential of the sum of its levels' multipliers. Newton steps run on
Spark, for all levels of a margin at once (inside a margin the Hessian is diagonal),
over token sums of the cells of equal levels; margins take turns until all fit.

Rates then become whole copies: everybody gets the whole part, and inside each
source documents get one more copy, in an order drawn from their ids, as long as any
fits what is missing; a last one may overshoot, if that is nearer to the target.

Null texts and sources are allowed (size 0; a source of its own). Repeated rows are
rows of their own. Without rows, or without words, nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 60
#: Rows of a running sum in one task; beyond its square, sums and tasks grow alike.
ROWS_PER_BUCKET = 2_000
NEAR = 1e-9


def token_sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint")


def share_targets(masses: DataFrame, level: str, weights: list[int], cap: float) -> DataFrame:
    """(level, mass) to (level, mass, target): weights in the order of the levels, null
    last, repeating; no target above ``cap`` times its mass, the excess shared again.

    Sharing the excess again and again ends where all uncapped levels have the same
    target per weight. Sorted by that bound, the capped ones come first.
    """
    in_order = Window.orderBy(F.col(level).asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    by_bound = Window.orderBy("_bound", F.col(level).asc_nulls_last())
    upto = by_bound.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("mass").over(everything)
    ranked = (
        masses.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
        .withColumn("_total", total.cast("double"))
        .withColumn("_bound", F.lit(float(cap)) * F.col("mass") / F.col("_weight"))
        .withColumn("_capped_before", F.sum(F.lit(float(cap)) * F.col("mass")).over(upto) - F.lit(float(cap)) * F.col("mass"))
        .withColumn("_weight_left", F.sum("_weight").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    ranked = ranked.withColumn("_rank", F.row_number().over(by_bound))
    # The level with this row as the first uncapped one; it holds from the first row where
    # it stays below the row's own bound. Equal bounds are told apart by their rank.
    level_here = (F.col("_total") - F.col("_capped_before")) / F.col("_weight_left")
    water = F.min(F.when(level_here <= F.col("_bound"), F.struct("_rank", level_here.alias("t"))))
    return ranked.withColumn("_water", water.over(everything)["t"]).select(
        level,
        "mass",
        F.least(F.lit(float(cap)) * F.col("mass"), F.col("_water") * F.col("_weight")).alias("target"),
    )


def _newton(mass: Column, target: Column) -> Column:
    """The multiplier at which mass * exp(multiplier) is the target, by damped Newton
    steps on the convex dual mass * exp(x) - target * x."""

    def step(x: Column, _: Column) -> Column:
        fitted = mass * F.exp(x)
        return x + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (target - fitted) / fitted))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    return F.when(target <= 0, F.lit(float("-inf"))).when(mass <= 0, F.lit(0.0)).otherwise(solved)


def balance(
    cells: DataFrame, margins: dict[str, DataFrame], work: Scratch, sweeps: int = 50, tolerance: float = 1e-6
) -> DataFrame:
    """Cells with ``mass`` and one column for each margin; adds ``_tilt``, the sum of the
    cell's multipliers. ``margins`` maps a column to its (column, target) rows."""
    tilted = work.save(cells.withColumn("_tilt", F.lit(0.0)), "tilt_0")
    done = 0
    for sweep in range(sweeps):
        for column, targets in margins.items():
            fitted = tilted.groupBy(column).agg(F.sum(F.col("mass") * F.exp("_tilt")).alias("_fitted"))
            wanted = targets.select(F.col(column).alias("_level"), "target")
            steps = fitted.join(wanted, F.col(column).eqNullSafe(F.col("_level")), "left").select(
                F.col(column).alias("_of"),
                F.coalesce(_newton(F.col("_fitted"), F.col("target")), F.lit(0.0)).alias("_step"),
            )
            moved = tilted.join(steps, F.col(column).eqNullSafe(F.col("_of"))).drop("_of")
            done += 1
            tilted = work.save(moved.withColumn("_tilt", F.col("_tilt") + F.col("_step")).drop("_step"), f"tilt_{done}")
        if len(margins) == 1:
            break  # one margin is solved by its own Newton steps
        gaps = []
        for column, targets in margins.items():
            fitted = tilted.groupBy(column).agg(F.sum(F.col("mass") * F.exp("_tilt")).alias("_fitted"))
            wanted = targets.select(F.col(column).alias("_level"), "target")
            both = fitted.join(wanted, F.col(column).eqNullSafe(F.col("_level")))
            gaps.append(both.agg(F.max(F.abs(F.col("_fitted") - F.col("target")) / F.greatest("target", F.lit(1.0)))).first()[0] or 0.0)
        if max(gaps) <= tolerance:
            break
    return tilted


def mix_sources(
    docs: DataFrame,
    weights: list[int],
    cap: float = 3.0,
    source: str = "source",
    doc_id: str = "doc_id",
    size: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target (of the
    source), rate, copies and taken (copies * size).

    Copies are at most ``cap``; per source, the words taken stay within one small
    document of the target where documents allow it. Reruns agree.
    """
    work = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (token_sizes(docs) if size is None else size).alias("size"),
    ).withColumn("_order", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    sized = work.save(sized, "sized")

    masses = work.save(sized.groupBy("source").agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("_rows")), "masses")
    targets = work.save(share_targets(masses.select("source", "mass"), "source", weights, cap), "targets")
    tilt = balance(masses.select("source", "mass"), {"source": targets.select("source", "target")}, work)

    # Per source: the rate, its whole part, and the words that extra copies must add.
    plan = (
        targets.alias("t")
        .join(tilt.select(F.col("source").alias("_s"), "_tilt"), F.col("source").eqNullSafe(F.col("_s")))
        .join(masses.select(F.col("source").alias("_m"), "_rows"), F.col("source").eqNullSafe(F.col("_m")))
        .select(
            F.col("source").alias("_source"),
            F.col("mass").alias("source_size"),
            "target",
            F.least(F.lit(float(cap)), F.exp("_tilt")).alias("rate"),
            F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.greatest(F.lit(ROWS_PER_BUCKET), F.sqrt("_rows")))).alias("_buckets"),
        )
        .withColumn("_whole", F.floor(F.col("rate") + NEAR))
        .withColumn("_gap", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
        .withColumn("_more", F.col("_whole") + 1 <= F.lit(float(cap) + NEAR))
    )
    plan = work.save(plan, "plan")
    same = F.col("source").eqNullSafe(F.col("_source"))

    rows = sized.join(plan, same).withColumn("_bucket", F.pmod("_order", "_buckets"))
    keys = ["source", "_bucket"]
    in_order = Window.partitionBy(*keys).orderBy("_order", "doc_id", "size")
    placed = rows.withColumn("_place", F.row_number().over(in_order))
    placed = work.save(placed.select("doc_id", "source", "size", "source_size", "target", "rate", "_whole", "_more", "_bucket", "_place"), "placed")

    # Documents that fit what is missing in their source, in order, until their sum does not
    # fit; again among the others that fit what is left then, until none does. The first
    # that did not fit never fits again, so this ends.
    state = work.save(plan.select("_source", F.col("_gap").alias("_left")), "left_0")
    pool = placed.where(F.col("_more") & (F.col("size") > 0)).select("source", "size", "_bucket", "_place")
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken, turn = None, 0
    while True:
        fits = pool.join(state, same).where(F.col("size") <= F.col("_left") + NEAR)
        # Running sums in two levels, so that a source with most of the rows is many windows.
        sums = fits.groupBy(*keys).agg(F.sum("size").alias("_sum"))
        before = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
        upto = F.col("_before") + F.sum("size").over(inside)
        ranked = (
            fits.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("_extra", upto <= F.col("_left") + NEAR)
            .select("source", "size", "_bucket", "_place", "_extra")
        )
        ranked = work.save(ranked, f"ranked_{turn}")
        added = ranked.where("_extra").groupBy("source").agg(F.sum("size").alias("_added"))
        if added.isEmpty():
            break
        chosen = ranked.where("_extra").select("source", "_bucket", "_place")
        taken = chosen if taken is None else taken.union(chosen)
        state = state.join(added, same, "left").select("_source", (F.col("_left") - F.coalesce("_added", F.lit(0))).alias("_left"))
        turn += 1
        state = work.save(state, f"left_{turn}")
        pool = ranked.where(~F.col("_extra"))

    if taken is None:
        placed = placed.withColumn("_extra", F.lit(0))
    else:
        taken = taken.select(F.col("source").alias("_t"), F.col("_bucket").alias("_tb"), F.col("_place").alias("_tp"))
        at = F.col("source").eqNullSafe(F.col("_t")) & (F.col("_bucket") == F.col("_tb")) & (F.col("_place") == F.col("_tp"))
        placed = placed.join(taken, at, "left").withColumn("_extra", F.col("_tp").isNotNull().cast("int")).drop("_t", "_tb", "_tp")
    placed = work.save(placed, "taken")

    # At last one document may overshoot, if that leaves a smaller gap than now.
    picked = (
        placed.where((F.col("_extra") == 0) & F.col("_more") & (F.col("size") > 0))
        .join(state, same)
        .where(F.col("size") < 2 * F.col("_left") - NEAR)
        .groupBy("source")
        .agg(F.max_by(F.struct("_bucket", "_place"), F.struct(-F.abs(F.col("_left") - F.col("size")), "_bucket", "_place")).alias("_pick"))
        .select(F.col("source").alias("_source"), "_pick")
    )
    picked = work.save(picked, "picked")
    last = F.coalesce((F.col("_pick._bucket") == F.col("_bucket")) & (F.col("_pick._place") == F.col("_place")), F.lit(False))
    copies = (F.col("_whole") + F.col("_extra") + last.cast("int")).cast("bigint")
    return (
        placed.join(picked, same, "left")
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
