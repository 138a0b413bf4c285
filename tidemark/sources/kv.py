"""Key-value export of latest views, for any store with a Spark connector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import KEY_PREFIX, encode, entity_key
from tidemark.spec import FeatureGroup
from tidemark.streaming.state import DELETE, OP


def export_kv(
    fg: FeatureGroup, latest: DataFrame, path: str | None = None, prefix: str = KEY_PREFIX
) -> DataFrame:
    """(key, fields) rows of a latest view; written as parquet when ``path`` is given."""
    encoded = encode(fg, latest, prefix)
    if path is not None:
        encoded.write.mode("overwrite").parquet(path)
    return encoded


def export_changes(
    fg: FeatureGroup, changed: DataFrame, path: str | None = None, prefix: str = KEY_PREFIX
) -> DataFrame:
    """(op, key, fields) rows of ``streaming.state.changes``, for a store that holds the export
    before: set the fields of each upsert in the place of what is there, drop each delete."""
    is_gone = F.col(OP) == DELETE
    kept = encode(fg, changed.filter(~is_gone), prefix).select(F.lit("upsert").alias("op"), "key", "fields")
    gone = changed.filter(is_gone).select(
        F.lit(DELETE).alias("op"),
        entity_key(fg, F.col(fg.entity), prefix).alias("key"),
        F.lit(None).cast("map<string,string>").alias("fields"),
    )
    out = kept.unionByName(gone)
    if path is not None:
        out.write.mode("overwrite").parquet(path)
    return out


def apply_changes(exported: DataFrame, changed: DataFrame) -> DataFrame:
    """An export with the changes made to it."""
    stays = exported.join(changed.select("key"), "key", "left_anti")
    return stays.unionByName(changed.filter(F.col("op") != DELETE).select("key", "fields"))
