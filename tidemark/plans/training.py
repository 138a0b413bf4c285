"""Training sets from stored feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timefns import as_utc_ntz
from tidemark.operators.pit import Keyed, point_in_time_join, point_in_time_join_keys
from tidemark.operators.skew import HOT_ROWS, reduce_to
from tidemark.sources.offline import read_features
from tidemark.spec import FeatureGroup


def training_set(
    spark: SparkSession,
    spine: DataFrame,
    groups: Sequence[FeatureGroup],
    root: str,
    entity_col: str,
    event_ts_col: str = "event_ts",
    *,
    prefix: bool = False,
    hot_rows: int | None = HOT_ROWS,
    reduce_to_spine: bool = True,
) -> DataFrame:
    """Point-in-time join of a spine with stored groups.

    Date folders after the spine's last event time are not read. If the spine has
    few distinct entities (counted, up to the broadcast bound), feature rows of
    other entities are dropped before the shuffle.
    """
    tables = _stored(spark, spine, [(entity_col, fg) for fg in groups], root, event_ts_col, reduce_to_spine)
    pairs = [(k.fg, k.rows) for k in tables]
    return point_in_time_join(
        spine, pairs, entity_col, event_ts_col, prefix=prefix, hot_rows=hot_rows
    )


def training_set_keys(
    spark: SparkSession,
    spine: DataFrame,
    groups: Mapping[str, Sequence[FeatureGroup]],
    root: str,
    event_ts_col: str = "event_ts",
    *,
    prefix: bool = False,
    hot_rows: int | None = HOT_ROWS,
    reduce_to_spine: bool = True,
) -> DataFrame:
    """The same for groups of several entities: ``groups`` maps a key column of the spine to
    the stored groups whose entity it names. One pass and one shuffle for each key."""
    pairs = [(key, fg) for key, listed in groups.items() for fg in listed]
    tables = _stored(spark, spine, pairs, root, event_ts_col, reduce_to_spine)
    return point_in_time_join_keys(spine, tables, event_ts_col, prefix=prefix, hot_rows=hot_rows)


def _stored(
    spark: SparkSession,
    spine: DataFrame,
    groups: Sequence[tuple[str, FeatureGroup]],
    root: str,
    event_ts_col: str,
    reduce_to_spine: bool,
) -> list[Keyed]:
    """Stored rows of each group as far as the spine can need them."""
    times = as_utc_ntz(F.col(event_ts_col), spine.schema[event_ts_col].dataType)
    last = spine.select(F.max(times)).scalar()
    tables = []
    for key, fg in groups:
        rows = read_features(spark, fg, root, until=last)
        if reduce_to_spine:
            entities = spine.select(F.col(key).alias(fg.entity)).filter(F.col(fg.entity).isNotNull())
            rows = reduce_to(rows, entities.distinct(), fg.entity)
        tables.append(Keyed(key, fg, rows))
    return tables
