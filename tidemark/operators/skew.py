"""Keeping one hot key from becoming one huge task.

A key counts as hot when it has at least ``hot_rows`` rows. A table of N rows
has at most N / hot_rows hot keys, which is what makes it safe to broadcast
the list of them, however large N is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task still sorts comfortably.
HOT_ROWS = 4_000_000

# Rows of a side table that may be broadcast after they have been counted.
BROADCAST_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows. Counts are combined before the shuffle."""
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= hot_rows)
        .select(key)
    )


def reduce_to(
    table: DataFrame, keys: DataFrame, key: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Drop table rows whose key is not asked for, before anything is shuffled.

    ``keys`` holds distinct keys; they are counted (up to the bound) and only
    broadcast within it. Beyond it the table is returned as it is. Spark pushes the
    semi join below an aggregation by the same key.
    """
    if keys.limit(max_rows + 1).count() > max_rows:
        return table
    return table.join(F.broadcast(keys), key, "left_semi")


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of many rows with a table that has one row per key.

    Rows of hot keys never enter the shuffle: the table rows of hot keys are few
    (see the module's bound) and are broadcast to them. Rows with a null key match
    nothing and skip the join. One job over the key column looks for hot keys.
    """
    added = [f for f in table.schema.fields if f.name != key]
    ordered = rows.columns + [f.name for f in added]
    keyed = rows.filter(F.col(key).isNotNull())
    keyless = rows.filter(F.col(key).isNull()).select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]
    )
    hot = hot_keys(rows.select(key), key, hot_rows)
    if hot.isEmpty():
        return keyed.join(table, key, "left").select(*ordered).unionByName(keyless)
    hot = F.broadcast(hot)
    hot_table = table.join(hot, key, "left_semi")
    near = keyed.join(hot, key, "left_semi").join(F.broadcast(hot_table), key, "left")
    far = keyed.join(hot, key, "left_anti").join(table, key, "left")
    return near.select(*ordered).unionByName(far.select(*ordered)).unionByName(keyless)


def side_table_join(
    rows: DataFrame,
    side: DataFrame,
    key: str,
    size_of: DataFrame | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join with a metadata table, one row per key, expected to be small.

    The side (or ``size_of``, the table it was packed from) is counted first; the
    count stops at the bound. Within the bound the side is broadcast; beyond it
    the skew-safe shuffle join takes over.
    """
    measured = side if size_of is None else size_of
    if measured.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(side), key, "left")
    return lookup_join(rows, side, key)
