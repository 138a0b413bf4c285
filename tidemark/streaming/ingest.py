"""Streaming ingestion: one transform feeds the offline table and the latest view.

Delivery is at least once: Spark's checkpoint commits a micro-batch only after
both writes have returned. A replayed micro-batch has the same number and
replaces its own files in both stores, so the replay leaves no duplicates.

A batch's accounts are observed while the offline rows are written: no pass of their own.
``progress.ProgressLog`` keeps what the stream itself reports.
"""

from __future__ import annotations

from dataclasses import dataclass

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.files import Files
from tidemark.functions.timefns import ntz_to_micros
from tidemark.operators.transform import (
    COUNTS,
    Transform,
    accepted,
    apply_transform,
    dead_letters,
    ingest_stats,
    observed_stats,
    stats_of,
)
from tidemark.sources.messages import Bounds
from tidemark.sources.offline import write_features
from tidemark.spec import EVENT_TS, INGEST_TS, WRITE_TS, FeatureGroup
from tidemark.streaming import state

# A batch is flushed at so many messages, or after this time.
FLUSH = Bounds(rows=1_000, delay="5 seconds")


@dataclass(frozen=True)
class Ingest:
    """Where one ingestion writes. ``name`` labels its batches; an ingestion that
    starts over with a new checkpoint needs a new name. ``partitions`` is how many
    partitions the source has: accounts are kept for each. Where it is not known (None),
    the accounts are counted in a pass of their own."""

    fg: FeatureGroup
    transform: Transform
    root: str
    state_path: str
    stats_path: str
    dead_letter_path: str
    name: str = "stream"
    partitions: int | None = None

    def label(self, batch_id: int) -> str:
        return f"{self.name}-{batch_id:012d}"

    def write_batch(self, messages: DataFrame, batch_id: int) -> None:
        """Offline first, then the latest view, then the batch's accounts."""
        label = self.label(batch_id)
        rows = apply_transform(self.fg, messages, self.transform)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            seen, counted = rows, None
            if self.partitions is not None:
                counted = Observation(f"accounts of {label}")
                seen = rows.observe(counted, *observed_stats(rows, self.partitions))
            good = accepted(self.fg, seen)
            arrival = ntz_to_micros(F.col(WRITE_TS)).alias(INGEST_TS)
            features = good.select(
                self.fg.entity, EVENT_TS, *self.fg.feature_names, arrival
            )
            write_features(self.fg, features, self.root, batch=label)
            state.add_writes(self.fg, accepted(self.fg, rows), self.state_path, label)
            dead_letters(rows).write.mode("overwrite").parquet(
                f"{self.dead_letter_path}/batch={label}"
            )
            if counted is None:
                self._count(rows, label)
            else:
                self._keep_counts(rows.sparkSession, stats_of(counted.get, self.partitions), label)
        finally:
            rows.unpersist()

    def _count(self, rows: DataFrame, label: str) -> None:
        stats = ingest_stats(rows).collect()  # one row for each partition of the source
        self._keep_counts(rows.sparkSession, [r.asDict() for r in stats], label)

    def _keep_counts(self, spark: SparkSession, stats: list[dict], label: str) -> None:
        lines = [json.dumps(r | {"batch_id": label}) for r in stats]
        Files(spark).write(f"{self.stats_path}/{label}.json", "\n".join(lines))


def start_ingest(
    messages: DataFrame,
    job: Ingest,
    checkpoint: str,
    available_now: bool = False,
    bounds: Bounds = FLUSH,
) -> StreamingQuery:
    """Start the stream. ``available_now`` ingests what is there, in batches as large as the
    source was bounded to, and stops.

    Otherwise the two bounds of ``bounds`` decide when a batch runs. A source that counts
    messages (``read_kafka`` with the same bounds) holds a batch back until it has
    ``rows`` messages or ``delay`` has passed, and is asked all the time; any other is
    asked every ``delay``, and its size bound only cuts what is there.
    """
    writer = messages.writeStream.foreachBatch(job.write_batch).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=bounds.interval).start()


def ingest_batch(messages: DataFrame, job: Ingest, batch_id: int = 0) -> None:
    """The same writes for a bounded table."""
    job.write_batch(messages, batch_id)


STATS = "partition int, " + ", ".join(f"{c} long" for c in COUNTS) + ", last_offset long, batch_id string"


def batch_stats(spark: SparkSession, job: Ingest) -> DataFrame:
    """The accounts of each micro-batch, one row for each partition of the source."""
    return spark.read.schema(STATS).json(job.stats_path)


def read_stats(spark: SparkSession, job: Ingest) -> DataFrame:
    """Totals over all micro-batches, one row for each partition of the source."""
    return (
        batch_stats(spark, job)
        .groupBy("partition")
        .agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("last_offset").alias("last_offset"))
    )


def drop_repeats(messages: DataFrame, keys: list[str], event_ts: str, delay: str) -> DataFrame:
    """Drop repeats of a stream within ``delay`` of event time, with bounded state."""
    # Watermarks need a zoned timestamp.
    instant = F.timestamp_micros(ntz_to_micros(F.col(event_ts)))
    marked = messages.withColumn("__at", instant).withWatermark("__at", delay)
    return marked.dropDuplicatesWithinWatermark(keys).drop("__at")
