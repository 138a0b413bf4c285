"""The record transform: one definition for batch and streaming sources.

No message can stop a batch: values are converted where that can fail without an
error, and the status is decided on what was converted. Rejected messages keep their
text and a reason.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefns import epoch_seconds_to_ntz
from tidemark.sources.messages import PARTITION, RAW
from tidemark.spec import EVENT_TS, SEQ, WRITE_TS, FeatureGroup

STATUS, REASON = "_status", "_reason"
OK, SKIPPED, ERROR = "ok", "skipped", "error"


@dataclass(frozen=True)
class Record:
    """Column expressions over a parsed message.

    ``event_ts`` is in epoch seconds. Where ``keep`` is false the message is
    skipped. ``valid`` adds a check of the message; a message that did not parse,
    or that lacks an entity or an event time, is an error in any case.
    """

    entity: Column
    values: dict[str, Column]
    event_ts: Column
    keep: Column | None = None
    valid: Column | None = None


Transform = Callable[[Column], Record]


@dataclass(frozen=True)
class Callback:
    """A Python function from a message (a dict) to a record or None (skip).

    The record is ``{"entity": ..., "values": {...}, "event_ts": epoch seconds}``. An
    exception makes that one message an error, with the exception as the reason.
    """

    function: Callable[[dict], dict | None]


def _call(fg: FeatureGroup, messages: DataFrame, callback: Callback, message: str) -> DataFrame:
    """The callback's results as one column ``_made``, in Arrow batches. Values travel as
    text and are typed afterwards like any other."""
    made = "struct<entity:string,values:map<string,string>,event_ts:string,skip:boolean,error:string>"
    function = callback.function

    def one(row: str | None) -> dict:
        found = {"entity": None, "values": None, "event_ts": None, "skip": False, "error": None}
        if row is None:
            return found
        try:
            record = function(json.loads(row))
            if record is None:
                return found | {"skip": True}
            values = {
                str(k): v if isinstance(v, str) else json.dumps(v)
                for k, v in record.get("values", {}).items()
                if v is not None
            }
            entity, at = record.get("entity"), record.get("event_ts")
            return found | {
                "entity": None if entity is None else str(entity),
                "values": values,
                "event_ts": None if at is None else str(at),
            }
        except Exception as failed:  # noqa: BLE001  whatever it is, it concerns one message
            return found | {"error": f"{type(failed).__name__}: {failed}"[:500]}

    @F.pandas_udf(made)
    def call(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [one(r) for r in rows], columns=["entity", "values", "event_ts", "skip", "error"]
        )

    return messages.withColumn("_made", call(F.to_json(message)))


def apply_transform(
    fg: FeatureGroup, messages: DataFrame, transform: Transform | Callback, message: str = "msg"
) -> DataFrame:
    """Messages -> (entity, features, ``_event_ts``, ``_status``, ``_reason``) plus arrival
    columns. ``transform`` gives column expressions, or is a ``Callback``; under ANSI an
    expression that can fail must be written with ``try_`` functions.

    Values outside the spec are dropped; a feature the transform does not provide is
    null (absent). Nothing is removed: split by ``_status`` with ``accepted`` and
    ``dead_letters``.
    """
    failed = F.lit(None).cast("string")
    if isinstance(transform, Callback):
        messages = _call(fg, messages, transform, message)
        made = F.col("_made")
        kinds = {f.name: f.spark_type for f in fg.features}
        values = {
            name: F.from_json(made["values"][name], kind) if isinstance(kind, T.ArrayType) else made["values"][name]
            for name, kind in kinds.items()
        }
        record = Record(made["entity"], values, made["event_ts"], keep=~made["skip"])
        failed = made["error"]
    else:
        record = transform(F.col(message))
    entity = record.entity
    if fg.entity_dtype is not None:
        entity = entity.try_cast(fg.entity_dtype.spark_type)
    event_ts = epoch_seconds_to_ntz(record.event_ts)
    keep = F.coalesce(F.lit(True) if record.keep is None else record.keep, F.lit(False))
    # A callback that skips gives neither entity nor time.
    skips = ~keep if isinstance(transform, Callback) else F.lit(False)
    reason = F.when(F.col(message).isNull(), F.lit("not parsed")).when(failed.isNotNull(), failed)
    reason = reason.when(skips, F.lit(None)).when(entity.isNull(), F.lit("no entity"))
    reason = reason.when(record.event_ts.isNull(), F.lit("no event time"))
    reason = reason.when(event_ts.isNull(), F.lit("event time out of range"))
    if record.valid is not None:
        reason = reason.when(~F.coalesce(record.valid, F.lit(False)), F.lit("not valid"))
    status = F.when(reason.isNotNull(), ERROR).when(keep, OK).otherwise(SKIPPED)
    features = []
    for f in fg.features:
        value = record.values.get(f.name, F.lit(None))
        features.append(value.try_cast(f.spark_type).alias(f.name))
    carried = [c for c in messages.columns if c not in (message, "_made")]
    return messages.select(
        entity.alias(fg.entity),
        event_ts.alias(EVENT_TS),
        *features,
        status.alias(STATUS),
        reason.alias(REASON),
        *[F.col(c) for c in carried if c not in (fg.entity, EVENT_TS)],
    )


def accepted(fg: FeatureGroup, rows: DataFrame) -> DataFrame:
    arrival = [c for c in (WRITE_TS, SEQ) if c in rows.columns]
    return rows.filter(F.col(STATUS) == OK).select(
        fg.entity, EVENT_TS, *fg.feature_names, *arrival
    )


def dead_letters(rows: DataFrame) -> DataFrame:
    """Rejected messages: text, reason, partition and offset, for repair and replay."""
    origin = [c for c in (RAW, PARTITION, SEQ, WRITE_TS) if c in rows.columns]
    return rows.filter(F.col(STATUS) == ERROR).select(*origin, REASON)


# Names of the counters, in the order of ``_counters``.
COUNTS = ("messages_consumed", "rows_written_online", "rows_written_offline", "skipped", "errors")
#: Beyond this many partitions of a source, accounts are grouped instead of observed.
OBSERVED_PARTITIONS = 512


def _counters(mine: Column) -> list[Column]:
    """What ``COUNTS`` count of the rows where ``mine`` holds. Both stores receive every
    accepted row."""
    ok = F.col(STATUS) == OK
    conditions = [F.lit(True), ok, ok & F.col(EVENT_TS).isNotNull(), F.col(STATUS) == SKIPPED, F.col(STATUS) == ERROR]
    return [F.count_if(mine & c) for c in conditions]


def _partition(rows: DataFrame, partition: str) -> Column:
    return F.col(partition).cast("int") if partition in rows.columns else F.lit(0)


def ingest_stats(rows: DataFrame, offset: str = SEQ, partition: str = PARTITION) -> DataFrame:
    """Counts over transformed messages, one row for each partition of the source (one in
    all where it has none)."""
    counters = [c.alias(n) for n, c in zip(COUNTS, _counters(F.lit(True)), strict=True)]
    by = _partition(rows, partition).alias(PARTITION)
    return rows.groupBy(by).agg(*counters, F.max(offset).alias("last_offset"))


def observed_stats(
    rows: DataFrame, partitions: int, offset: str = SEQ, partition: str = PARTITION
) -> list[Column]:
    """The same counts as metrics of ``observe``, for partitions 0 to ``partitions`` - 1.
    Rows of any other partition are counted as well, so that none is lost silently."""
    if partitions > OBSERVED_PARTITIONS:
        raise ValueError(f"observe at most {OBSERVED_PARTITIONS} partitions, group the others")
    at = _partition(rows, partition)
    metrics = []
    for p in range(partitions):
        mine = at == p
        metrics += [c.alias(f"{n}_{p}") for n, c in zip(COUNTS, _counters(F.coalesce(mine, F.lit(False))), strict=True)]
        metrics.append(F.max(F.when(mine, F.col(offset))).alias(f"last_offset_{p}"))
    other = ~F.coalesce(at.between(0, partitions - 1), F.lit(False))
    return [*metrics, F.count_if(other).alias("elsewhere")]


def stats_of(metrics: dict, partitions: int) -> list[dict]:
    """Rows of ``ingest_stats`` from observed metrics; partitions without messages have none."""
    if metrics.get("elsewhere"):
        raise ValueError(f"{metrics['elsewhere']} messages come from partitions beyond {partitions}")
    rows = []
    for p in range(partitions):
        if metrics.get(f"{COUNTS[0]}_{p}"):
            rows.append({PARTITION: p, "last_offset": metrics[f"last_offset_{p}"]} | {n: metrics[f"{n}_{p}"] for n in COUNTS})
    return rows
