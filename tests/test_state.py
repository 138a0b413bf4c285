import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureGroup
from tidemark.files import Files
from tidemark.operators.latest import latest_view
from tidemark.sources.kv import apply_changes, export_changes, export_kv
from tidemark.streaming import state

T0 = datetime(2024, 9, 1)
KIND = "sensor string, heat double, mode string, _event_ts timestamp_ntz, _write_ts timestamp_ntz, _seq long"


def group(ttl):
    return FeatureGroup("sensors", "sensor", (Feature("heat", "float64"), Feature("mode", "string")), ttl_seconds=ttl)


def writes(seed, n, start, sensors):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(minutes=start + i // 4)
        rows.append((f"s{draw.randrange(sensors)}", draw.choice([None, draw.randrange(9) / 2]), draw.choice([None, "on", "off"]), at, at, start * 1000 + i))
    return rows


def add(spark, fg, path, label, rows):
    state.add_writes(fg, spark.createDataFrame(rows, KIND).repartition(2), path, label)


def view(df):
    return Counter(map(tuple, df.collect()))


def test_every_hash_has_one_bucket():
    buckets = state._new_buckets(2)
    assert buckets == (4, 5, 6, 7)
    grown = sorted([4, *state._split(5, 1), 6, *state._split(7, 3)])
    depths = {b: state._depth(b) for b in grown}
    for h in range(256):
        assert sum((1 << d) + (h & ((1 << d) - 1)) == b for b, d in depths.items()) == 1


def test_buckets_of_uneven_depth_are_looked_up(spark):
    fg = group(0)
    buckets = tuple(sorted([4, *state._split(5, 1), 6, *state._split(7, 3)]))
    rows = spark.range(500).select(F.concat(F.lit("s"), "id").alias("sensor"))
    found = rows.select(state._bucket(fg, buckets).alias("b"), F.xxhash64("sensor").alias("h")).collect()
    for r in found:
        d = state._depth(r.b)
        assert r.b in buckets and r.b == (1 << d) + (r.h & ((1 << d) - 1))


def test_state_splits_as_it_grows_and_reads_alike(spark, tmp_path):
    fg, rows = group(0), []
    paths = {name: str(tmp_path / name) for name in ("few", "many")}
    for i in range(3):
        new = writes(i, 400, 100 * i, 150 * (i + 1))
        rows += new
        for name, path in paths.items():
            add(spark, fg, path, f"b{i}", new)
            state.compact(spark, fg, path, bucket_bytes=1 << 30 if name == "few" else 2_500)
    files = Files(spark)
    few, many = (state._newest(files, p) for p in paths.values())
    assert len(few.buckets) == 32 and len(many.buckets) >= 64
    wanted = view(latest_view(fg, spark.createDataFrame(rows, KIND)))
    for path in paths.values():
        assert view(state.read_latest(spark, fg, path)) == wanted
        state.vacuum(spark, path)
        assert view(state.read_latest(spark, fg, path)) == wanted
    # Each bucket is written by a task of its own.
    number = many.number
    folders = [n for n in files.names(f"{paths['many']}/base/gen={number}") if n.startswith("bucket=")]
    assert len(folders) > 32
    assert {len([f for f in files.names(f"{paths['many']}/base/gen={number}/{n}") if f.endswith(".parquet")]) for n in folders} == {1}


@pytest.mark.parametrize("ttl", [0, 1800])
@pytest.mark.parametrize("bucket_bytes", [1 << 30, 2_000])
def test_export_and_changes_make_the_next_export(spark, tmp_path, ttl, bucket_bytes):
    fg, path = group(ttl), str(tmp_path)
    times = [T0 + timedelta(minutes=m) for m in (60, 130, 131, 300)]
    exports, generations = [], []
    for i, (start, sensors) in enumerate([(0, 40), (70, 400), (131, 3)]):
        add(spark, fg, path, f"b{i}", writes(i, 200, start, sensors))
        generations.append(state.compact(spark, fg, path, bucket_bytes))
        exports.append(view_kv(export_kv(fg, state.generation_view(spark, fg, path, generations[-1], times[i]))))
    steps = [(0, 1, None, 0), (1, 2, 0, 1), (2, 3, 1, 2), (1, 3, 0, 2)]
    for before, after, t_before, t_after in steps:
        at_before = None if t_before is None else times[t_before]
        changed = export_changes(fg, state.changes(spark, fg, path, before, after, at_before, times[t_after]))
        base = export_kv(fg, state.generation_view(spark, fg, path, before, at_before))
        assert view_kv(apply_changes(base, changed)) == exports[after - 1]
        # Only what differs is sent, and no key twice.
        keys = [r.key for r in changed.select("key").collect()]
        assert len(keys) == len(set(keys))
        old = view_kv(base)
        assert all(old.get(r.key) != dict(r.fields) for r in changed.filter("op = 'upsert'").collect())
    # Without new writes, time alone takes records away.
    only_time = state.changes(spark, fg, path, 3, 3, times[2], times[3])
    assert {r[0] for r in only_time.select(state.OP).distinct().collect()} <= {state.DELETE}
    assert (only_time.count() > 0) == (ttl > 0)
    if ttl:
        after = view_kv(export_kv(fg, state.generation_view(spark, fg, path, 3, times[3])))
        base = export_kv(fg, state.generation_view(spark, fg, path, 3, times[2]))
        assert view_kv(apply_changes(base, export_changes(fg, only_time))) == after


def view_kv(df):
    return {r.key: dict(r.fields) for r in df.collect()}


def test_untouched_buckets_are_not_compared(spark, tmp_path):
    fg, path = group(0), str(tmp_path)
    add(spark, fg, path, "a", writes(1, 300, 0, 200))
    first = state.compact(spark, fg, path)
    add(spark, fg, path, "b", [("s1", 99.0, "on", T0, T0 + timedelta(days=1), 10**9)])
    state.compact(spark, fg, path)
    found = state.changes(spark, fg, path, first)
    assert [(r[0], r.sensor, r.heat) for r in found.collect()] == [("upsert", "s1", 99.0)]
    assert len(set(found.inputFiles())) <= 2
