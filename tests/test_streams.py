import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Feature, FeatureGroup
from tidemark.files import Files
from tidemark.operators import latest as lv
from tidemark.operators import transform as tf
from tidemark.sources import messages as ms
from tidemark.streaming import ingest, progress, stateful

T0 = datetime(2022, 3, 1)
SECOND = 1_000_000


class Map(dict):
    """A map state in memory."""

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        assert isinstance(v, tuple)
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Times:
    def __init__(self, ms_):
        self.ms = ms_

    def getCurrentWatermarkInMs(self):
        return self.ms


def group(ttl):
    return FeatureGroup("beats", "id", (Feature("a", "int64"), Feature("b", "string")), ttl_seconds=ttl)


def plain_view(writes, ttl):
    """(a, b, event, last) after all writes in order of arrival; a pause wipes everything."""
    held, last = {}, None
    for at, seq, event, a, b in sorted(writes, key=lambda w: w[:2]):
        if last is not None and ttl and at - last >= ttl * SECOND:
            held = {}
        held |= {k: v for k, v in (("a", a), ("b", b)) if v is not None} | {"event": event}
        last = at
    return held.get("a"), held.get("b"), held["event"], last


@pytest.mark.parametrize("ttl", [0, 7])
@pytest.mark.parametrize("seed", range(12))
def test_state_equals_all_writes_in_any_batches(ttl, seed):
    """Writes arrive up to 5 s out of order, in batches of any size; the watermark runs 6 s
    behind."""
    draw = random.Random(seed)
    fg = group(ttl)
    writes, at = [], 0
    for seq in range(120):
        at += int(draw.choice([0, 0.4, 1, 3, 6.9, 7, 9, 25]) * SECOND)
        writes.append((at, seq, at - draw.randint(0, 9), draw.choice([None, draw.randint(0, 99)]), draw.choice([None, f"b{seq}"])))
    order = sorted(writes, key=lambda w: w[0] + draw.randint(0, 5 * SECOND))
    p = stateful._Latest(fg)
    p.init(Handle())
    done, watermark, emitted = [], 0, None
    while order:
        batch = order[: draw.randint(1, 9)]
        order = order[len(batch) :]
        rows = []
        for w in batch:
            at_, seq, event, a, b = w
            cell = at_ - at_ % (ttl * SECOND) if ttl else 0
            own = [(at_, seq, a) if a is not None else (None, None, None), (at_, seq, b) if b is not None else (None, None, None)]
            rows.append(("key", cell, at_, at_, event, seq, *own[0], *own[1], None))
        done += batch
        times = Times(watermark)
        for row in p.handleInputRows(("key",), iter(rows), times):
            emitted = row
        for timer in sorted(t for t in p.handle.timers if t <= watermark):
            p.handle.timers.remove(timer)
            for row in p.handleExpiredTimer(("key",), times, None):
                emitted = row
        newest = max(w[0] for w in done)
        if not emitted[-1]:
            assert tuple(emitted)[1:5] == plain_view(done, ttl)
        else:
            assert ttl and newest + ttl * SECOND <= watermark * 1000
        # The state holds one settled cell and those of the watermark's delay.
        assert len(p.cells) <= 1 + sum(v[1] > watermark * 1000 for v in p.cells.values())
        assert len(p.handle.timers) == (1 if ttl and not emitted[-1] else 0)
        watermark = max(watermark, (newest - 6 * SECOND) // 1000)


@pytest.mark.parametrize("ttl", [0, 7])
def test_a_micro_batch_reads_and_writes_an_entity_once(ttl):
    calls = []

    class Counted(Handle):
        def registerTimer(self, at):
            calls.append("register")
            super().registerTimer(at)

        def deleteTimer(self, at):
            calls.append("delete")
            super().deleteTimer(at)

        def _state(self, state):
            for name in ("iterator", "updateValue", "removeKey", "exists", "get", "update", "clear"):
                if hasattr(state, name):
                    setattr(state, name, lambda *a, f=getattr(state, name), n=name: (calls.append(n), f(*a))[1])
            return state

        def getMapState(self, *_):
            return self._state(Map())

        def getValueState(self, *_):
            return self._state(Value())

    p = stateful._Latest(group(ttl))
    p.init(Counted())
    for i in range(3):
        calls.clear()
        rows = [("key", at - at % (7 * SECOND), at, at, at, i, at, i, i, None, None, None, None) for at in range(20 * i * SECOND, 20 * (i + 1) * SECOND, 4 * SECOND)]
        list(p.handleInputRows(("key",), iter(rows), Times(20_000 * i)))
        assert sorted(calls) == sorted(["get", "update"] + (["register"] + ["delete"] * (i > 0) if ttl else []))


KIND = "id string, a long, b string, _event_ts timestamp_ntz, _write_ts timestamp_ntz, _seq long"


def random_writes(seed, n, ids):
    draw = random.Random(seed)
    rows, at = [], T0
    for seq in range(n):
        at += timedelta(seconds=draw.choice([0, 1, 2, 40]))
        rows.append((draw.choice(ids), draw.choice([None, 2**60 + seq]), draw.choice([None, f"x{seq}"]), at - timedelta(hours=draw.randint(0, 5)), at, seq))
    return rows


def run(spark, fg, path, tmp_path, **options):
    writes = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = stateful.start_stateful(fg, writes, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True, **options)
    query.awaitTermination()


@pytest.mark.parametrize("ttl", [0, 60])
def test_stream_resumes_compacts_and_equals_the_batch_view(spark, tmp_path, ttl):
    fg = group(ttl)
    ids = ["hot"] * 20 + [f"u{i}" for i in range(12)] + [None]
    rows = random_writes(ttl, 600, ids)
    out, path = str(tmp_path / "out"), str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[150 * i : 150 * i + 150], KIND).repartition(3).write.mode("append").parquet(path)
        run(spark, fg, path, tmp_path, delay="30 seconds")
        if i == 1:
            assert stateful.compact_changes(spark, fg, out) == stateful.compact_changes(spark, fg, out)
            before = sorted(map(tuple, stateful.read_stateful(spark, fg, out).collect()))
            stateful.vacuum_changes(spark, out)
            assert sorted(map(tuple, stateful.read_stateful(spark, fg, out).collect())) == before
    as_of = rows[-1][4] + timedelta(seconds=1)
    wanted = lv.latest_view(fg, spark.createDataFrame(rows, KIND), as_of=as_of)
    found = stateful.read_stateful(spark, fg, out, as_of=as_of)
    assert found.schema.fieldNames() == wanted.schema.fieldNames()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if ttl:
        changes = spark.read.parquet(f"{out}/changes")
        assert changes.filter("_expired").count() > 0


def test_folds_combine_inside_a_task(spark):
    fg = FeatureGroup("lists", "id", (Feature("v", "float_list"),), ttl_seconds=0)
    rows = [("a", [float(i)], T0, T0 + timedelta(seconds=i), i) if i % 3 else ("a", None, T0, T0 + timedelta(seconds=i), i) for i in range(1000)]
    writes = spark.createDataFrame(rows, "id string, v array<double>, _event_ts timestamp_ntz, _write_ts timestamp_ntz, _seq long").coalesce(1)
    found = stateful.fold_writes(fg, writes).collect()
    assert len(found) == 1
    assert (found[0].v, found[0]['__at_v'] % SECOND, found[0]._seq) == ([998.0], 0, 999)
    assert "Exchange" not in stateful.fold_writes(fg, writes)._jdf.queryExecution().executedPlan().toString()


def test_bounds_become_source_options():
    assert ms.Bounds(rows=1000, delay="5 seconds").kafka_options() == {"minOffsetsPerTrigger": "1000", "maxTriggerDelay": "5seconds"}
    assert ms.Bounds(rows=1000, most_rows=50_000).kafka_options()["maxOffsetsPerTrigger"] == "50000"
    assert ms.Bounds(most_bytes=1 << 20).file_options() == {"maxBytesPerTrigger": str(1 << 20)}
    assert ms.Bounds(rows=5).interval == ms.POLL and ms.Bounds(delay="2 seconds").interval == "2 seconds"
    with pytest.raises(ValueError, match="not by both"):
        ms.Bounds(most_bytes=1, most_files=1).file_options()
    assert (ingest.FLUSH.rows, ingest.FLUSH.delay) == (1000, "5 seconds")


MESSAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("a", T.LongType()), T.StructField("at", T.DoubleType())])


def land(spark, path, n, partitions, file_rows, start=0):
    rows = [(f'{{"id": "u{i % 5}", "a": {i}, "at": {1.6e9 + i}}}' if i % 7 else "{", i % partitions, i, T0 + timedelta(seconds=i)) for i in range(start, start + n)]
    ms.land_messages(spark.createDataFrame(rows, ms.LANDED), path, file_rows)


def record(msg):
    return tf.Record(entity=msg["id"], values={"a": msg["a"]}, event_ts=msg["at"], keep=msg["a"] % 2 == 0)


def job_at(tmp_path, partitions):
    paths = {k: str(tmp_path / k) for k in ("root", "state_path", "stats_path", "dead_letter_path")}
    return ingest.Ingest(group(0), record, partitions=partitions, **paths)


def start(spark, job, tmp_path, bounds):
    messages = ms.read_landed(spark, str(tmp_path / "in"), MESSAGE, bounds=bounds)
    return ingest.start_ingest(messages, job, str(tmp_path / "checkpoint"), available_now=True, bounds=bounds)


@pytest.mark.parametrize("partitions", [None, 3])
def test_batches_are_bounded_and_accounted_for(spark, tmp_path, partitions):
    land(spark, str(tmp_path / "in"), 250, 3, 40)
    job, bounds = job_at(tmp_path, partitions), ms.Bounds(most_files=1)
    with progress.ProgressLog(spark, str(tmp_path / "progress")) as log:
        progress.await_batches(start(spark, job, tmp_path, bounds), log)
        land(spark, str(tmp_path / "in"), 50, 3, 40, start=250)
        progress.await_batches(start(spark, job, tmp_path, bounds), log)
    sizes = [r[0] for r in ingest.batch_stats(spark, job).groupBy("batch_id").agg(F.sum("messages_consumed")).select(F.col("sum(messages_consumed)")).collect()]
    # 84, 83 and 83 messages in files of 40, then 17 or 16 from each partition.
    assert sorted(sizes) == sorted([40, 40, 4, 40, 40, 3, 40, 40, 3, 16, 17, 17])
    rows = tf.apply_transform(job.fg, ms.read_landed(spark, str(tmp_path / "in"), MESSAGE, stream=False), record)
    wanted = {r.partition: r.asDict() for r in tf.ingest_stats(rows).collect()}
    assert {r.partition: r.asDict() for r in ingest.read_stats(spark, job).collect()} == wanted
    log_rows = progress.read_progress(spark, str(tmp_path / "progress")).collect()
    assert sum(r.input_rows for r in log_rows) >= 300 and len({r.batch_id for r in log_rows if r.source_rows}) == 12
    assert len(progress.last_offsets(spark, str(tmp_path / "progress")).collect()) >= 1


def test_observed_accounts_need_no_pass_of_their_own(spark, tmp_path):
    land(spark, str(tmp_path / "in"), 60, 3, 1000)
    messages = ms.read_landed(spark, str(tmp_path / "in"), MESSAGE, stream=False)
    tracker = spark.sparkContext.statusTracker()

    def jobs(job, name):
        spark.sparkContext.setJobGroup(name, name)
        job.write_batch(messages, 0)
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(name))

    observed = jobs(job_at(tmp_path / "x", 3), "observed")
    grouped = jobs(job_at(tmp_path / "y", None), "grouped")
    assert observed < grouped
    a, b = (ingest.read_stats(spark, job_at(tmp_path / k, 3)).orderBy("partition").collect() for k in "xy")
    assert a == b and len(a) == 3


def test_messages_of_unknown_partitions_are_not_lost_silently(spark, tmp_path):
    land(spark, str(tmp_path / "in"), 20, 5, 1000)
    messages = ms.read_landed(spark, str(tmp_path / "in"), MESSAGE, stream=False)
    with pytest.raises(ValueError, match="beyond 3"):
        job_at(tmp_path, 3).write_batch(messages, 0)
    with pytest.raises(ValueError, match="at most"):
        tf.observed_stats(messages, 10_000)


def test_a_replayed_batch_replaces_its_accounts(spark, tmp_path):
    land(spark, str(tmp_path / "in"), 30, 3, 1000)
    messages = ms.read_landed(spark, str(tmp_path / "in"), MESSAGE, stream=False)
    job = job_at(tmp_path, 3)
    for _ in range(2):
        job.write_batch(messages, 4)
    assert ingest.read_stats(spark, job).agg(F.sum("messages_consumed")).first()[0] == 30


def test_offsets_by_topic_and_partition(spark, tmp_path):
    files, path = Files(spark), str(tmp_path)
    for batch, (a, b) in enumerate([(5, 7), (9, 7)]):
        line = f'{{"query":"q","run_id":"r","batch_id":{batch},"at":"{batch}","source":0,"end_offset":"{{\\"t\\":{{\\"0\\":{a},\\"1\\":{b}}}}}"}}'
        files.write(f"{path}/{batch}.json", line)
    found = {(r.partition, r.offset) for r in progress.last_offsets(spark, path).collect()}
    assert found == {("t-0", "9"), ("t-1", "7")}


def test_files_are_swapped_whole(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "a" / "x")
    files.write(path, "one")
    files.write(path, "two")
    assert files.read(path) == "two" and files.names(str(tmp_path / "a")) == ["x"]
    files.write(str(tmp_path / "b" / "f"), "y")
    files.rename(str(tmp_path / "b"), str(tmp_path / "c" / "d"))
    assert files.read(str(tmp_path / "c" / "d" / "f")) == "y"
    with pytest.raises(OSError, match="cannot move"):
        files.rename(str(tmp_path / "a"), str(tmp_path / "c" / "d"))
