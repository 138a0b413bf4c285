"""Metrics over a log of served predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Latency bucket bounds in seconds.
PREDICT_BUCKETS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
FEATURE_FETCH_BUCKETS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1)


def predict_counts(log: DataFrame, by: tuple[str, ...] = ("model_name", "mode")) -> DataFrame:
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("predictions"))


def latency_histogram(
    log: DataFrame,
    latency: str,
    buckets: tuple[float, ...] = PREDICT_BUCKETS,
    by: str = "model_name",
) -> DataFrame:
    """Cumulative latency buckets: (by, le, count, total_count, total_seconds).

    Each row is counted once in the first bucket that holds it; the running sum
    over the few buckets makes them cumulative. ``le`` of the last is infinity.
    """
    bounds = [*buckets, float("inf")]
    bounds_column = F.array(*[F.lit(b) for b in bounds])
    slot = F.lit(len(buckets))
    for i in reversed(range(len(buckets))):
        slot = F.when(F.col(latency) <= buckets[i], F.lit(i)).otherwise(slot)
    counted = (
        log.filter(F.col(latency).isNotNull())
        .groupBy(by, slot.alias("slot"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(latency).alias("seconds"))
    )

    def below(column: str, i: Column) -> Column:
        mine = F.filter("slots", lambda s: s["slot"] <= i)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda t, s: t + s[column])

    return (
        counted.groupBy(by)
        .agg(
            F.collect_list(F.struct("slot", "rows")).alias("slots"),
            F.sum("rows").alias("total_count"),
            F.sum("seconds").alias("total_seconds"),
        )
        .select("*", F.posexplode(bounds_column).alias("i", "le"))
        .select(by, "le", below("rows", F.col("i")).alias("count"), "total_count", "total_seconds")
    )


def latency_quantiles(
    log: DataFrame, latency: str, probabilities: tuple[float, ...] = (0.5, 0.99), by: str = "model_name"
) -> DataFrame:
    """Approximate latency percentiles per model."""
    return log.groupBy(by).agg(
        F.percentile_approx(latency, list(probabilities), 10_000).alias("latency_quantiles")
    )


def shadow_agreement(scored: DataFrame, by: str = "model_name") -> DataFrame:
    """How far each shadow version agrees with the served prediction.

    ``failures`` are requests the shadow should have scored but did not; agreement
    and mean absolute difference are over the others.
    """
    rows = scored.select(
        by,
        "prediction",
        "shadow_predictions",
        F.explode("shadow_versions").alias("shadow_version"),
    ).withColumn(
        "shadow",
        F.col("shadow_predictions")[F.concat(F.lit("v"), F.col("shadow_version").cast("string"))],
    )
    ok = F.col("shadow").isNotNull() & F.col("prediction").isNotNull()
    same = F.when(F.col("prediction") == F.col("shadow"), 1.0).otherwise(0.0)
    return rows.groupBy(by, "shadow_version").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("shadow").isNull()).alias("failures"),
        F.avg(F.when(ok, same)).alias("agreement"),
        F.avg(F.when(ok, F.abs(F.col("prediction") - F.col("shadow")))).alias("mean_abs_diff"),
    )


def cohort_split(
    log: DataFrame, entity_col: str = "entity_id", by: tuple[str, ...] = ("model_name", "model_version")
) -> DataFrame:
    """Share of entities and of requests per version.

    Requests are first combined per (version, entity), so one very busy entity
    adds one row.
    """
    per_entity = log.groupBy(*by, entity_col).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(by[0])
    return (
        per_entity.groupBy(*by)
        .agg(F.count(entity_col).alias("entities"), F.sum("n").alias("requests"))
        .withColumn("request_share", F.col("requests") / F.sum("requests").over(whole))
        .withColumn("entity_share", F.col("entities") / F.sum("entities").over(whole))
    )
