"""Rolling activity features that feed a feature group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEVER = 999


def rolling_features(
    events: DataFrame,
    entity: str,
    event_ts: str,
    is_login: Column,
    session_seconds: Column,
    used_feature: Column,
    days: int = 30,
) -> DataFrame:
    """Per entity and active day, over the last ``days`` days including that day:
    login count, mean session seconds, distinct product features used, and days
    since the last login ever (999 if none).

    Events fold to one row per (entity, day) before the windows run. Distinct features are
    counted without sets: each is in use from its first day until ``days`` after a day that
    it does not come back in time, and the number in use is a running sum of such starts
    and ends.
    """
    known = events.filter(F.col(entity).isNotNull() & F.col(event_ts).isNotNull())
    daily = (
        known.groupBy(entity, F.to_date(event_ts).alias("day"))
        .agg(
            F.count_if(is_login).alias("logins"),
            F.sum(session_seconds).alias("seconds"),
            F.count(session_seconds).alias("sessions"),
        )
        .withColumns({"day_number": F.unix_date("day"), "change": F.lit(0)})
    )
    daily = daily.unionByName(
        _changes(known, entity, event_ts, used_feature, days), allowMissingColumns=True
    )
    by_day = W.partitionBy(entity).orderBy("day_number")
    recent = by_day.rangeBetween(-(days - 1), 0)
    ever = by_day.rangeBetween(W.unboundedPreceding, 0)
    last_login = F.max(F.when(F.col("logins") > 0, F.col("day_number"))).over(ever)
    sessions = F.sum("sessions").over(recent)
    in_use = F.sum("change").over(ever)
    found = daily.select(
        entity,
        "day",
        F.sum("logins").over(recent).alias("login_count"),
        F.when(sessions > 0, F.sum("seconds").over(recent) / sessions)
        .otherwise(F.lit(0.0))
        .alias("avg_session_seconds"),
        F.coalesce(F.col("day_number") - last_login, F.lit(NEVER))
        .cast("bigint")
        .alias("days_since_last_login"),
        in_use.cast("bigint").alias("num_features_used"),
    )
    return found.filter(F.col("day").isNotNull())


def _changes(
    events: DataFrame, entity: str, event_ts: str, feature: Column, days: int
) -> DataFrame:
    """(entity, day_number, change): how many features come into use less those that leave."""
    uses = events.select(
        entity, F.unix_date(F.to_date(event_ts)).alias("at"), feature.alias("feature")
    )
    uses = uses.filter(F.col("feature").isNotNull()).distinct()
    of_one = W.partitionBy(entity, "feature").orderBy("at")
    before, after = F.lag("at").over(of_one), F.lead("at").over(of_one)
    starts = F.when(before.isNull() | (F.col("at") - before >= days), F.struct(F.col("at"), F.lit(1)))
    ends = F.when(
        after.isNull() | (after - F.col("at") >= days), F.struct(F.col("at") + days, F.lit(-1))
    )
    kind = "struct<day_number:int,change:int>"
    turns = uses.select(entity, starts.cast(kind).alias("__start"), ends.cast(kind).alias("__end")).select(
        entity, F.explode(F.array("__start", "__end")).alias("turn")
    )
    return (
        turns.filter(F.col("turn").isNotNull())
        .groupBy(entity, F.col("turn.day_number").alias("day_number"))
        .agg(F.sum("turn.change").cast("int").alias("change"))
    )
