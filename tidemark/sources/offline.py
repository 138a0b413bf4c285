"""Offline feature tables: date-partitioned, append-only parquet.

Layout: ``<root>/<group>_v<version>/batch=<label>/date=YYYY-MM-DD/*.parquet`` and
``_spec/spec.json``. A batch owns its ``batch=`` folder, so writing the same batch again
replaces exactly its own rows, whatever their dates; batches never touch one another.
The spec lies beside the rows: a batch whose spec removes or retypes a stored feature
is refused before anything is written. ``sources.compaction`` folds batches into few files.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.files import Files
from tidemark.functions.timefns import as_utc_ntz
from tidemark.sources import compaction
from tidemark.spec import EVENT_TS, INGEST_TS, FeatureGroup, FeatureType


def table_path(fg: FeatureGroup, root: str) -> str:
    return f"{root.rstrip('/')}/{fg.table_name}"


def check_columns(fg: FeatureGroup, df: DataFrame) -> None:
    """Reject a batch without all columns of the spec, or with other types."""
    missing = sorted({fg.entity, EVENT_TS, *fg.feature_names} - set(df.columns))
    if missing:
        raise ValueError(f"{fg.name}: missing columns {missing}")
    for f in fg.features:
        found = df.schema[f.name].dataType
        if not _compatible(found, f.spark_type):
            raise ValueError(
                f"{fg.name}.{f.name}: {found.simpleString()} is not {f.dtype.value}"
            )


def _compatible(found: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(found, T.NullType) or found == wanted:
        return True
    if isinstance(found, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return _compatible(found.elementType, wanted.elementType)
    if isinstance(wanted, T.LongType):
        return isinstance(found, T.IntegralType)
    if isinstance(wanted, T.DoubleType):
        return isinstance(found, (T.FloatType, T.IntegralType))
    return False


def write_features(
    fg: FeatureGroup,
    df: DataFrame,
    root: str,
    batch: str | None = None,
    observation: Observation | None = None,
) -> str:
    """Append one batch of feature rows and return the table's path.

    Rows with a null event time have no partition and are left out; an
    ``observation`` receives ``rows`` and ``dropped`` counted during the write.
    Extra columns are kept. ``rebalance`` lets the adaptive planner pack small
    dates together and split large ones into several files.
    """
    check_columns(fg, df)
    path = table_path(fg, root)
    _keep_spec(df.sparkSession, fg, path)
    if batch is None:
        batch = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    else:
        compaction.mark_rewritten(Files(df.sparkSession), path, batch)
    event_ts = as_utc_ntz(F.col(EVENT_TS), df.schema[EVENT_TS].dataType)
    rows = df.withColumns(
        {f.name: F.col(f.name).cast(f.spark_type) for f in fg.features} | {EVENT_TS: event_ts}
    )
    if INGEST_TS not in df.columns:
        rows = rows.withColumn(INGEST_TS, F.lit(time.time_ns() // 1000))
    if observation is not None:
        rows = rows.observe(
            observation,
            F.count(EVENT_TS).alias("rows"),
            F.count_if(F.col(EVENT_TS).isNull()).alias("dropped"),
        )
    rows = rows.filter(F.col(EVENT_TS).isNotNull()).withColumn("date", F.to_date(EVENT_TS))
    (
        rows.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "zstd")
        .partitionBy("date")
        .parquet(f"{path}/batch={batch}")
    )
    return path


def _keep_spec(spark: SparkSession, fg: FeatureGroup, path: str) -> None:
    """Check the spec against the stored one, and store it if it is new or has grown."""
    files, folder = Files(spark), f"{path}/_spec"
    if "spec.json" in files.names(folder):
        stored = FeatureGroup.from_json(files.read(f"{folder}/spec.json"))
        if not check_evolution(T.StructType([f.struct_field() for f in stored.features]), fg)["added"]:
            return
    files.write(f"{folder}/spec.json", fg.to_json())


def read_features(
    spark: SparkSession,
    fg: FeatureGroup,
    root: str,
    until: object = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows of a group version in the shape of the current spec.

    Features added after a file was written read as null. ``until`` (a date, or a
    column such as a scalar subquery) prunes later date folders. ``keep`` names
    extra stored columns to return as well. A table without data is empty.
    """
    path, files = table_path(fg, root), Files(spark)
    manifest = compaction.read_manifest(files, path)
    parts = compaction.parts_of(files, path, manifest)
    if not parts.batches and not parts.packs:
        text = FeatureType.STRING.spark_type
        declared = fg.entity_dtype.spark_type if fg.entity_dtype else text
        return spark.createDataFrame([], _table_schema(fg, declared, []))
    try:
        schema = stored_schema(spark, fg, path, keep)
    except AnalysisException as missing:
        # Batches without rows have no files to tell a type.
        if missing.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], _table_schema(fg, FeatureType.STRING.spark_type, []))
    if manifest.number:
        table = compaction.read_parts(spark, path, parts, schema)
    else:
        partitions = [T.StructField("date", T.DateType()), T.StructField("batch", T.StringType())]
        table = spark.read.schema(T.StructType([*schema.fields, *partitions])).parquet(path)
    if until is not None:
        bound = until if not isinstance(until, str) else F.lit(until)
        table = table.filter(F.col("date") <= F.to_date(bound))
    return table.select(*schema.fieldNames())


def stored_schema(spark: SparkSession, fg: FeatureGroup, path: str, keep: list[str] | None = None) -> T.StructType:
    """The columns that are read: entity, event time, features, arrival, and ``keep``. Types
    that the spec does not say are those of the stored files."""
    declared = fg.entity_dtype.spark_type if fg.entity_dtype else None
    extra = []
    if declared is None or keep:
        files = Files(spark)
        parts = compaction.parts_of(files, path, compaction.read_manifest(files, path))
        stored = compaction.stored_fields(spark, path, parts)
        declared = declared or stored[fg.entity].dataType
        extra = [stored[c] for c in keep or []]
    return _table_schema(fg, declared, extra)


def _table_schema(
    fg: FeatureGroup, entity_type: T.DataType, extra: list[T.StructField]
) -> T.StructType:
    return T.StructType(
        [
            T.StructField(fg.entity, entity_type),
            T.StructField(EVENT_TS, T.TimestampNTZType()),
            *fg.schema().fields,
            T.StructField(INGEST_TS, T.LongType()),
            *extra,
        ]
    )


def dedup_features(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop the repeats that at-least-once delivery leaves behind."""
    keys = subset or [c for c in df.columns if c != INGEST_TS]
    return df.dropDuplicates(keys)


def check_evolution(stored: T.StructType, fg: FeatureGroup) -> dict[str, list[str]]:
    """Compare stored features with a spec: they may be added, not removed or retyped."""
    meta = {fg.entity, EVENT_TS, INGEST_TS, "date", "batch"}
    old = {f.name: f.dataType for f in stored.fields if f.name not in meta}
    new = {f.name: f.spark_type for f in fg.features}
    diff = {
        "added": sorted(new.keys() - old.keys()),
        "removed": sorted(old.keys() - new.keys()),
        "retyped": sorted(n for n in old.keys() & new.keys() if old[n] != new[n]),
    }
    if diff["removed"] or diff["retyped"]:
        raise ValueError(f"{fg.name} v{fg.version} needs a new version: {diff}")
    return diff
