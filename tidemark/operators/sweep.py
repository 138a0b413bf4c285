"""Routing through a deployment log of any size, without a model's history in one array.

Requests and deployments of a model lie on one timeline, cut into chunks at times that
leave about ``starts`` deployment starts in each. A chunk holds its own starts and the
deployments still in force from before; of those that never end only the ones that can
still decide something are carried on (the first of each share or version). A task sweeps
one chunk: between two changes of what is in force, the answer depends on the bucket
alone, so that each state is worked out once, whatever the number of requests. Chunks with
many requests are dealt to several tasks, each with the chunk's deployments.

The chunk borders are the only thing on the driver: at most ``MOST_BORDERS``, and one for
each partition of the sorted starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefns import as_utc_ntz, ntz_to_micros
from tidemark.operators.registry import deployment_intervals
from tidemark.spec import CANARY, PRODUCTION, SHADOW

#: Deployment starts of a chunk, and the most borders that chunks may have.
STARTS, MOST_BORDERS = 2_000, 20_000
#: Requests of a chunk that one task answers.
REQUESTS = 500_000
NO_DEPLOYMENT = "no active deployment"
NOT_SERVABLE = "no servable deployment"
_BUCKETS = 100
_FOREVER = np.iinfo(np.int64).max
_DEPLOYMENT = "struct<id:long,version:int,mode:string,pct:int,since:long,until:long>"


def _borders(starts: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Times (microseconds) at which a model's next chunk begins, from its sorted starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = None, 0
        for batch in batches:
            out: list[tuple[str, int]] = []
            for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m != model:
                    # A model that the partition before began goes on in a chunk of its own.
                    if model is None:
                        out.append((m, t))
                    model, seen = m, 0
                if seen == size:
                    out.append((m, t))
                    seen = 0
                seen += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["model", "at"])

    n = max(1, starts.count() // (8 * size))
    ordered = starts.repartitionByRange(n, "model", "since").sortWithinPartitions("model", "since")
    rows = ordered.mapInArrow(cut, "model string, at long").distinct().collect()
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r["model"], []).append(r["at"])
    return {m: np.array(sorted(t), np.int64) for m, t in found.items()}


def _chunk_of(borders: dict[str, np.ndarray]) -> object:
    @F.pandas_udf(T.LongType())
    def chunk(model: pd.Series, at: pd.Series) -> pd.Series:
        out = np.zeros(len(model), np.int64)
        times = at.to_numpy(np.int64)
        for name, rows in model.groupby(model).indices.items():
            if name in borders:
                out[rows] = np.searchsorted(borders[name], times[rows], "right")
        return pd.Series(out)

    return chunk


def _carried(log: DataFrame) -> DataFrame:
    """Deployments with ``lasts``: whether later chunks have to know of them. One that never
    ends decides nothing once another that never ends has a smaller id, an earlier start,
    and the same share (canaries) or version (shadows)."""
    def first(by: str) -> Column:
        before = W.partitionBy("model", "mode", by).orderBy("since", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
        open_ids = F.when(F.col("until") == _FOREVER, F.col("id"))
        return F.min(open_ids).over(before) >= F.col("id")

    ends = (F.col("until") < _FOREVER) | (F.col("mode") == PRODUCTION)
    kept = F.when(ends, True).when(F.col("mode") == CANARY, first("pct")).otherwise(first("version"))
    return log.withColumn("lasts", kept)


def _answers(since: np.ndarray, until: np.ndarray, rows: list[dict], at: np.ndarray, bucket: np.ndarray) -> tuple[list, list, list, list]:
    """(version, mode, shadow versions, error) of each request of one chunk."""
    times = np.unique(np.concatenate([since, until[until < _FOREVER]]))
    state = np.searchsorted(times, at, "right")
    changes: dict[int, list[tuple[bool, int]]] = {}
    for i, (a, z) in enumerate(zip(np.searchsorted(times, since).tolist(), np.searchsorted(times, until).tolist(), strict=True)):
        if since[i] < until[i]:
            changes.setdefault(a + 1, []).append((True, i))
            if z < len(times):
                changes.setdefault(z + 1, []).append((False, i))
    order = np.argsort(state, kind="stable")
    bounds = np.searchsorted(state[order], np.arange(len(times) + 2))
    version: list = [None] * len(at)
    mode, error, shadows = version.copy(), version.copy(), version.copy()
    active: dict[int, dict] = {}
    for s in range(len(times) + 1):
        for begins, i in changes.get(s, ()):
            if begins:
                active[i] = rows[i]
            else:
                active.pop(i, None)
        mine = order[bounds[s] : bounds[s + 1]]
        if not len(mine):
            continue
        held = sorted(active.values(), key=lambda d: d["id"])
        canaries = [d for d in held if d["mode"] == CANARY]
        rest = next((d for d in held if d["mode"] == PRODUCTION), canaries[0] if canaries else None)
        # The last place is for requests without a bucket, which no share covers.
        chosen = [rest] * (_BUCKETS + 1)
        for d in reversed(canaries):
            share = min(max(d["pct"] or 0, 0), _BUCKETS)
            chosen[:share] = [d] * share
        watching = list(dict.fromkeys(d["version"] for d in held if d["mode"] == SHADOW))
        failed = NO_DEPLOYMENT if not held else None if rest else NOT_SERVABLE
        for i, b in zip(mine.tolist(), bucket[mine].tolist(), strict=True):
            d = chosen[b]
            shadows[i] = watching
            if d is None:
                error[i] = failed
            else:
                version[i], mode[i] = d["version"], d["mode"]
    return version, mode, shadows, error


def route_sweep(
    requests: DataFrame,
    deployment_log: DataFrame,
    bucket: Column,
    request_ts: str = "request_ts",
    model_col: str = "model_name",
    starts: int = STARTS,
    request_rows: int = REQUESTS,
) -> DataFrame:
    """Requests with ``bucket``, ``model_version``, ``mode``, ``shadow_versions`` and
    ``route_error``, by the deployments in force at their own time.

    A request without a time or a model has no active deployment. Rows that are equal in
    every column are answered by one task.
    """
    named = deployment_intervals(deployment_log)
    micros = {c: ntz_to_micros(as_utc_ntz(F.col(c), named.schema[c].dataType)) for c in ("created_at", "valid_to")}
    log = named.select(
        F.col("model_name").alias("model"),
        F.col("id").cast("bigint").alias("id"),
        F.col("model_version").cast("int").alias("version"),
        "mode",
        F.col("traffic_pct").cast("int").alias("pct"),
        micros["created_at"].alias("since"),
        F.coalesce(micros["valid_to"], F.lit(_FOREVER)).alias("until"),
    ).filter(F.col("model").isNotNull() & F.col("since").isNotNull())
    size = max(starts, log.count() // MOST_BORDERS)
    borders = _borders(log.select("model", "since"), size)
    chunk = _chunk_of(borders)

    at = ntz_to_micros(as_utc_ntz(F.col(request_ts), requests.schema[request_ts].dataType))
    asked = requests.select(
        F.coalesce(F.col(model_col), F.lit("")).alias("model"),
        F.coalesce(at, F.lit(np.iinfo(np.int64).min)).alias("at"),
        bucket.cast("int").alias("bucket"),
        F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("__r"),
    ).withColumn("chunk", chunk("model", "at"))
    full = asked.groupBy("model", "chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > request_rows)
    # A chunk that is dealt out holds more than request_rows requests: there are few of them.
    parts = F.broadcast(full.select("model", "chunk", F.ceil(F.col("n") / F.lit(request_rows)).cast("int").alias("parts")))
    spread = F.pmod(F.xxhash64(F.to_json("__r")), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    asked = asked.join(parts, ["model", "chunk"], "left").withColumn("part", spread).drop("parts")

    last = F.when(F.col("lasts"), chunk("model", "until")).otherwise(F.col("from"))
    spans = _carried(log).withColumn("from", chunk("model", "since"))
    spans = spans.withColumn("chunk", F.explode(F.sequence("from", F.greatest(last, F.col("from")))))
    held = spans.join(parts, ["model", "chunk"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    deployment = F.struct("id", "version", "mode", "pct", "since", "until").alias("d")
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("at", "bucket", "__r")]
    timeline = asked.select("model", "chunk", "part", F.lit(None).cast(_DEPLOYMENT).alias("d"), "at", "bucket", "__r")
    timeline = timeline.unionByName(held.select("model", "chunk", "part", deployment, *nothing))

    out = T.StructType(
        [
            asked.schema["__r"],
            T.StructField("bucket", T.IntegerType()),
            T.StructField("model_version", T.IntegerType()),
            T.StructField("mode", T.StringType()),
            T.StructField("shadow_versions", T.ArrayType(T.IntegerType())),
            T.StructField("route_error", T.StringType()),
        ]
    )

    def sweep(table: pa.Table) -> pa.Table:
        is_request = pc.is_valid(table["__r"])
        mine = table.filter(is_request)
        rows = table.filter(pc.invert(is_request))["d"].to_pylist()
        since, until = (np.array([d[c] for d in rows], np.int64) for c in ("since", "until"))
        buckets = pc.fill_null(mine["bucket"], _BUCKETS).to_numpy().astype(np.int64)
        version, mode, shadows, error = _answers(since, until, rows, mine["at"].to_numpy(), buckets)
        columns = [mine["__r"], mine["bucket"], pa.array(version, pa.int32()), pa.array(mode, pa.string()), pa.array(shadows, pa.list_(pa.int32())), pa.array(error, pa.string())]
        return pa.table(columns, names=out.fieldNames())

    swept = timeline.groupBy("model", "chunk", "part").applyInArrow(sweep, out)
    return swept.select("__r.*", *out.fieldNames()[1:])
