"""The latest value of each entity, kept in the stream's own state.

One state per entity, in RocksDB: its ttl cells with their folded writes, and its timer, as
one value that is read and written once for each micro-batch it has rows in. Writes are
folded inside each task before they are shuffled, so an entity that holds a third of a
micro-batch arrives as a few rows. Within an entity the rules are those of
``operators.latest``: fields merge by arrival, and a pause of at least ttl wipes the record.

The watermark follows write time. A pause is final once the watermark has reached the
write that ended it; what lies before is then dropped, and cells that nothing can change
any more are merged, so that the state of an entity holds one cell and those of the
watermark's delay. A timer at the last write plus ttl ends the record: its state is
removed and a row with ``_expired`` is emitted. Writes older than the watermark may be
dropped; all others give the same result in any order and in any micro-batches.

Each micro-batch emits the records that changed. ``start_stateful`` keeps them below
``<path>/changes/batch=<number>/`` (a replayed batch replaces its own); ``read_stateful``
takes the newest row of each entity, and ``compact_changes`` folds old batches into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.files import Files
from tidemark.functions.timefns import as_of_literal, as_utc_ntz, micros_to_ntz, ntz_to_micros
from tidemark.operators.latest import CELL, FIRST_WRITE, LAST_WRITE
from tidemark.spec import EVENT_TS, SEQ, WRITE_TS, FeatureGroup

EXPIRED = "_expired"
BATCH = "_batch"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed names: state stores upload only what a micro-batch changed.
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def _at(name: str) -> str:
    return f"__at_{name}"


def _seq(name: str) -> str:
    return f"__seq_{name}"


def _cell_fields(fg: FeatureGroup) -> list[T.StructField]:
    whole = [T.StructField(c, T.LongType()) for c in (FIRST_WRITE, LAST_WRITE, EVENT_TS, SEQ)]
    for f in fg.features:
        whole += [T.StructField(_at(f.name), T.LongType()), T.StructField(_seq(f.name), T.LongType()), T.StructField(f.name, f.spark_type)]
    return whole


def fold_writes(fg: FeatureGroup, writes: DataFrame) -> DataFrame:
    """Writes to one row for each entity and ttl cell of an Arrow batch. No shuffle: this is
    the combine before the stateful operator, which cannot follow an aggregation."""
    write = ntz_to_micros(as_utc_ntz(F.col(WRITE_TS), writes.schema[WRITE_TS].dataType))
    event = ntz_to_micros(as_utc_ntz(F.col(EVENT_TS), writes.schema[EVENT_TS].dataType))
    ttl = fg.ttl_seconds * 1_000_000
    cell = write - F.pmod(write, F.lit(ttl)) if ttl > 0 else F.lit(0).cast("bigint")
    rows = writes.filter(F.col(fg.entity).isNotNull() & write.isNotNull()).select(
        fg.entity,
        cell.alias(CELL),
        write.alias("__write"),
        F.coalesce(F.col(SEQ).cast("bigint"), F.lit(0)).alias(SEQ),
        F.coalesce(event, write).alias(EVENT_TS),
        *[F.col(f.name).cast(f.spark_type).alias(f.name) for f in fg.features],
    )
    names, entity = fg.feature_names, fg.entity
    schema = T.StructType([rows.schema[entity], T.StructField(CELL, T.LongType()), *_cell_fields(fg)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by([("__write", "ascending"), (SEQ, "ascending")])
            place = pa.array(np.arange(len(table)))
            marked = table.select([entity, CELL, "__write"]).append_column("__last", place)
            for n in names:
                marked = marked.append_column(n, pc.if_else(pc.is_valid(table[n]), place, pa.scalar(None, pa.int64())))
            # The last place of each field says which write it comes from.
            wanted = [("__write", "min"), ("__write", "max"), ("__last", "max"), *((n, "max") for n in names)]
            found = marked.group_by([entity, CELL]).aggregate(wanted)
            last = found["__last_max"]
            columns = [found[entity], found[CELL], found["__write_min"], found["__write_max"], table[EVENT_TS].take(last), table[SEQ].take(last)]
            for n in names:
                at = found[f"{n}_max"]
                columns += [table["__write"].take(at), table[SEQ].take(at), table[n].take(at)]
            out = pa.table([pa.chunked_array(c.chunks, c.type) for c in columns], names=schema.fieldNames())
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(fold, schema)


class _Latest(StatefulProcessor):
    """Cells are tuples (first write, last write, event time, seq, then for each feature the
    time and seq of its write and its value)."""

    def __init__(self, fg: FeatureGroup):
        self.ttl = fg.ttl_seconds * 1_000_000
        self.width = len(fg.features)
        self.schema = T.StructType(_cell_fields(fg))
        cell = T.StructType([T.StructField(CELL, T.LongType()), *self.schema.fields])
        self.kept = T.StructType([T.StructField("timer", T.LongType()), T.StructField("cells", T.ArrayType(cell))])
        #: The cells of the entity handled last.
        self.cells: dict[int, tuple] = {}
        self.row = Row(fg.entity, *fg.feature_names, EVENT_TS, LAST_WRITE, EXPIRED)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", self.kept)

    def _read(self) -> tuple[int | None, dict[int, tuple]]:
        """An entity's timer and cells. Each call to a state goes from Python to the JVM and back."""
        found = self.state.get()
        return (found[0], {c[0]: tuple(c[1:]) for c in found[1]}) if found else (None, {})

    def merged(self, a: tuple | None, b: tuple) -> tuple:
        """Two folds of writes in one; merging one again changes nothing."""
        if a is None:
            return b
        newest = a if (a[1], a[3]) >= (b[1], b[3]) else b
        out = [min(a[0], b[0]), max(a[1], b[1]), newest[2], newest[3]]
        for i in range(4, 4 + 3 * self.width, 3):
            x, y = a[i : i + 3], b[i : i + 3]
            out += x if y[0] is None or (x[0] is not None and (x[0], x[1]) >= (y[0], y[1])) else y
        return tuple(out)

    def islands(self, cells: dict[int, tuple]) -> list[list[int]]:
        """Cells in order, cut at pauses of at least ttl."""
        out: list[list[int]] = []
        until = None
        for key in sorted(cells, key=lambda k: cells[k][:2]):
            if until is None or (self.ttl > 0 and cells[key][0] - until >= self.ttl):
                out.append([])
            out[-1].append(key)
            until = cells[key][1] if until is None else max(until, cells[key][1])
        return out

    def settled(self, cells: dict[int, tuple], watermark: int) -> dict[int, tuple]:
        """The cells that still matter: what a final pause wiped is gone, and what no write
        can come between is one cell."""
        islands = self.islands(cells)
        begin = max((i for i, x in enumerate(islands) if cells[x[0]][0] <= watermark), default=0)
        out = {k: cells[k] for x in islands[begin:] for k in x}
        old = [k for k in islands[begin] if cells[k][1] <= watermark]
        if len(old) > 1:
            whole = None
            for k in old:
                whole = self.merged(whole, out.pop(k))
            out[old[0]] = whole
        return out

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues: object) -> Iterator:
        timer, before = self._read()
        cells = dict(before)
        for row in rows:
            values = tuple(row)
            # An entity, its cell and the fold; the event time of the watermark comes last.
            cells[values[1]] = self.merged(cells.get(values[1]), values[2 : 2 + len(self.schema)])
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.cells = cells = self.settled(cells, watermark)
        whole = None
        for k in self.islands(cells)[-1]:
            whole = self.merged(whole, cells[k])
        ends = self._move_timer(timer, whole[1]) if self.ttl > 0 else None
        if ends != timer or cells != before:
            self.state.update((ends, [(k, *v) for k, v in cells.items()]))
        values = [whole[6 + 3 * i] for i in range(self.width)]
        yield self.row(key[0], *values, whole[2], whole[1], False)

    def _move_timer(self, old: int | None, last: int) -> int:
        ends = -(-(last + self.ttl) // 1000)
        if old != ends:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ends)
        return ends

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator:
        last = max(v[1] for v in self._read()[1].values())
        self.cells = {}
        self.state.clear()
        yield self.row(key[0], *[None] * self.width, None, last, True)

    def close(self) -> None:
        pass


def latest_changes(fg: FeatureGroup, writes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The records that each micro-batch of a stream of writes changes: entity, features,
    ``_event_ts`` and ``_last_write`` in microseconds, ``_expired``.

    ``delay`` is how much older than the newest write a write may be and still count.
    """
    folded = fold_writes(fg, writes)
    timed = folded.withColumn("__at", F.timestamp_micros(F.col(LAST_WRITE))).withWatermark("__at", delay)
    out = T.StructType(
        [
            folded.schema[fg.entity],
            *[T.StructField(f.name, f.spark_type) for f in fg.features],
            T.StructField(EVENT_TS, T.LongType()),
            T.StructField(LAST_WRITE, T.LongType()),
            T.StructField(EXPIRED, T.BooleanType()),
        ]
    )
    return timed.groupBy(fg.entity).transformWithState(_Latest(fg), out, "Update", "EventTime")


def start_stateful(
    fg: FeatureGroup,
    writes: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = "1 hour",
    available_now: bool = False,
    interval: str = "5 seconds",
) -> StreamingQuery:
    """Keep the latest view of a stream of writes in state, and its changes below ``path``."""
    spark = writes.sparkSession

    def keep(changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/changes/batch={batch_id:012d}")

    writer = latest_changes(fg, writes, delay).writeStream.outputMode("update").foreachBatch(keep)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    # A query keeps the session's settings of the moment it starts.
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER, _CHANGELOG)}
    try:
        spark.conf.set(_PROVIDER, _ROCKSDB)
        spark.conf.set(_CHANGELOG, "true")
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _changes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All kept changes with their batch, and the newest batch. Batches up to the newest
    folded one are read from the fold."""
    files = Files(spark)
    folds = files.names(f"{path}/folded")
    upto = int(folds[-1].removeprefix("upto=")) if folds else -1
    batches = [b for b in files.names(f"{path}/changes") if int(b.removeprefix("batch=")) > upto]
    # Only a batch that was written to its end has this file; the others are written again.
    done = [b for b in batches if files.exists(f"{path}/changes/{b}/_SUCCESS")]
    parts = [spark.read.parquet(f"{path}/folded/{folds[-1]}")] if folds else []
    parts += [spark.read.parquet(f"{path}/changes/{b}").withColumn(BATCH, F.lit(int(b.removeprefix("batch="))).cast("bigint")) for b in done]
    if not parts:
        raise FileNotFoundError(f"no changes below {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, max([upto, *(int(b.removeprefix("batch=")) for b in done)])


def _newest(fg: FeatureGroup, rows: DataFrame) -> DataFrame:
    """The newest row of each entity; in one batch a record expires before it is written."""
    rest = [c for c in rows.columns if c != fg.entity]
    order = F.struct(BATCH, ~F.col(EXPIRED), LAST_WRITE)
    return rows.groupBy(fg.entity).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(fg.entity, "__r.*")


def read_stateful(spark: SparkSession, fg: FeatureGroup, path: str, as_of: object = None) -> DataFrame:
    """The latest view: records that have not expired in the stream, nor by ``as_of``."""
    rows, _ = _changes(spark, path)
    view = _newest(fg, rows).filter(~F.col(EXPIRED))
    if as_of is not None and fg.ttl_seconds > 0:
        now = ntz_to_micros(as_of_literal(as_of))
        view = view.filter(F.col(LAST_WRITE) + F.lit(fg.ttl_seconds * 1_000_000) > now)
    return view.select(fg.entity, *fg.feature_names, micros_to_ntz(F.col(EVENT_TS)).alias(EVENT_TS))


def compact_changes(spark: SparkSession, fg: FeatureGroup, path: str) -> int:
    """Fold all kept batches into one table of newest rows and return the last batch folded.
    Readers see the old batches or the fold, never both; the stream need not stop."""
    rows, upto = _changes(spark, path)
    files, name = Files(spark), f"upto={upto:012d}"
    if name not in files.names(f"{path}/folded"):
        _newest(fg, rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/_folding/{name}")
        files.rename(f"{path}/_folding/{name}", f"{path}/folded/{name}")
    return upto


def vacuum_changes(spark: SparkSession, path: str) -> None:
    """Remove batches and folds that the newest fold replaces."""
    files = Files(spark)
    folds = files.names(f"{path}/folded")
    if not folds:
        return
    upto = int(folds[-1].removeprefix("upto="))
    for b in files.names(f"{path}/changes"):
        if int(b.removeprefix("batch=")) <= upto:
            files.delete(f"{path}/changes/{b}")
    for f in folds[:-1]:
        files.delete(f"{path}/folded/{f}")
