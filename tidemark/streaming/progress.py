"""What a stream reports about each of its micro-batches, kept beside its data.

The listener runs on the driver and writes one small file for each micro-batch, named by
run and batch, so that a restart adds to what earlier runs have left. It reads no data.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.files import Files

PROGRESS = (
    "query string, run_id string, batch_id long, at string, input_rows long, seconds double, "
    "source int, source_name string, start_offset string, end_offset string, source_rows long, "
    "state_rows long, late_rows long, observed string"
)


class ProgressLog(StreamingQueryListener):
    """Writes the progress of all queries (or of those named ``only``) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, only: set[str] | None = None):
        self.spark, self.path, self.only = spark, path, only
        self.files = Files(spark)

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure: object) -> None:
        self.drain()
        self.spark.streams.removeListener(self)

    def drain(self, seconds: float = 60.0) -> None:
        """Wait until all progress reported so far is written."""
        bus = self.spark.sparkContext._jsc.sc().listenerBus()
        bus.waitUntilEmpty(int(seconds * 1000))

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        if self.only is not None and p.name not in self.only:
            return
        lines = _lines(p)
        self.files.write(f"{self.path}/{p.runId}-{p.batchId:012d}.json", "\n".join(lines))


def _lines(p: object) -> list[str]:
    """One line for each source of a batch."""
    state = p.stateOperators or []
    shared = {
        "query": p.name,
        "run_id": str(p.runId),
        "batch_id": p.batchId,
        "at": p.timestamp,
        "input_rows": p.numInputRows,
        "seconds": (p.durationMs or {}).get("triggerExecution", 0) / 1000,
        "state_rows": sum(s.numRowsTotal for s in state),
        "late_rows": sum(s.numRowsDroppedByWatermark for s in state),
        "observed": json.dumps({k: r.asDict() for k, r in (p.observedMetrics or {}).items()}, default=str),
    }
    return [
        json.dumps(
            shared
            | {"source": i, "source_name": s.description, "source_rows": s.numInputRows}
            | {"start_offset": s.startOffset, "end_offset": s.endOffset}
        )
        for i, s in enumerate(p.sources)
    ]


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row for each micro-batch and source. A batch that ran again is there once, as the
    later run reports it."""
    rows = spark.read.schema(PROGRESS).json(path)
    rest = [c for c in rows.columns if c not in ("query", "batch_id", "source")]
    newest = F.max_by(F.struct(*rest), F.struct("at", "run_id")).alias("r")
    return rows.groupBy("query", "batch_id", "source").agg(newest).select("query", "batch_id", "source", "r.*")


def last_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(query, source, partition, offset) that each source has been read up to. Offsets that
    are kept by topic and partition are rows of their own; any other is one row."""
    ends = read_progress(spark, path).groupBy("query", "source").agg(F.max_by("end_offset", "batch_id").alias("end"))
    by_topic = F.from_json("end", "map<string,map<string,bigint>>")
    whole = ends.where(by_topic.isNull()).select("query", "source", F.lit(None).cast("string").alias("partition"), F.col("end").alias("offset"))
    topics = ends.where(by_topic.isNotNull()).select("query", "source", F.explode(by_topic).alias("topic", "parts"))
    parts = topics.select("query", "source", "topic", F.explode("parts").alias("part", "offset"))
    named = parts.select("query", "source", F.concat_ws("-", "topic", "part").alias("partition"), F.col("offset").cast("string").alias("offset"))
    return named.unionByName(whole)


def await_batches(query: StreamingQuery, log: ProgressLog) -> None:
    """Wait for the end of a bounded query and of its progress reports."""
    query.awaitTermination()
    log.drain()
