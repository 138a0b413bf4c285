import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureGroup
from tidemark.files import Files
from tidemark.sources import compaction as cm
from tidemark.sources import offline

FG = FeatureGroup("visits", "who", (Feature("n", "int64"), Feature("tag", "string")), entity_dtype="int64")
KIND = "who long, n long, tag string, _event_ts timestamp_ntz, _ingest_ts long, note string"
T0 = datetime(2019, 12, 30)


def batch(seed, n=40, days=4):
    draw = random.Random(seed)
    return [(draw.randrange(9), draw.randrange(1000), draw.choice([None, "a", "b"]), T0 + timedelta(minutes=draw.randrange(days * 1440)), seed, f"s{seed}") for _ in range(n)]


def write(spark, root, label, rows, fg=FG):
    offline.write_features(fg, spark.createDataFrame(rows, KIND), root, batch=label)


def read(spark, root, fg=FG, **options):
    return Counter(map(tuple, offline.read_features(spark, fg, root, **options).collect()))


def expected(*batches):
    return Counter((w, t, n, tag, i) for rows in batches for w, n, tag, t, i, _ in rows)


def test_table_is_the_same_through_folds_replays_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    held = {f"b{i}": batch(i) for i in range(5)}
    for label, rows in held.items():
        write(spark, root, label, rows)
    before = cm.file_counts(spark, FG, root)

    def same():
        assert read(spark, root) == expected(*held.values())

    assert cm.compact_features(spark, FG, root) == 1
    same()
    after = cm.file_counts(spark, FG, root)
    assert after.keys() == before.keys() and set(after.values()) == {1} and sum(before.values()) >= 3 * len(before)
    # Written again before the old folder is removed, and with other dates.
    held["b2"] = batch(102, days=2)
    write(spark, root, "b2", held["b2"])
    same()
    cm.vacuum_features(spark, FG, root)
    same()
    held["b3"], held["b7"] = batch(103), batch(7)
    for label in ("b3", "b7"):
        write(spark, root, label, held[label])
    same()
    cm.compact_features(spark, FG, root)
    same()
    cm.vacuum_features(spark, FG, root)
    same()
    files = Files(spark)
    path = offline.table_path(FG, root)
    assert [n for n in files.names(path) if n.startswith("batch=")] == []
    assert files.names(f"{path}/_void") == [] and len(files.names(f"{path}/_manifest")) == 1
    # Nothing new: nothing changes.
    cm.compact_features(spark, FG, root)
    same()
    # Once more a batch that only lies in packs.
    held["b0"] = batch(100)
    write(spark, root, "b0", held["b0"])
    same()
    cm.compact_features(spark, FG, root)
    same()


def test_a_failed_replay_does_not_bring_old_rows_back(spark, tmp_path):
    root, held = str(tmp_path), {f"b{i}": batch(i) for i in range(3)}
    for label, rows in held.items():
        write(spark, root, label, rows)
    cm.compact_features(spark, FG, root)
    cm.vacuum_features(spark, FG, root)
    # The marker is there, the rows are not yet.
    cm.mark_rewritten(Files(spark), offline.table_path(FG, root), "b1")
    assert read(spark, root) == expected(held["b0"], held["b2"])
    cm.compact_features(spark, FG, root)
    assert read(spark, root) == expected(held["b0"], held["b2"])
    write(spark, root, "b1", held["b1"])
    assert read(spark, root) == expected(*held.values())


def test_unfinished_batches_are_not_folded(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root, "a", batch(1))
    write(spark, root, "b", batch(2))
    files, path = Files(spark), offline.table_path(FG, root)
    files.delete(f"{path}/batch=b/_SUCCESS")
    cm.compact_features(spark, FG, root)
    assert cm.read_manifest(files, path).folded == {"a"}
    assert read(spark, root) == expected(batch(1), batch(2))


def test_full_packs_are_left_alone_and_large_dates_have_several_files(spark, tmp_path):
    root = str(tmp_path)
    rows = [(i, i, f"t{i * 7919}", T0, 1, "x") for i in range(5000)]
    write(spark, root, "a", rows)
    cm.compact_features(spark, FG, root, file_bytes=10_000)
    day = str(T0.date())
    assert cm.file_counts(spark, FG, root)[day] >= 3
    write(spark, root, "b", rows[:10])
    cm.compact_features(spark, FG, root, file_bytes=10_000)
    m = cm.read_manifest(Files(spark), offline.table_path(FG, root))
    assert [g for g, _ in m.packs[day]] == [1, 2]
    assert read(spark, root) == expected(rows, rows[:10])


def test_evolved_and_extra_columns_survive(spark, tmp_path):
    root = str(tmp_path)
    wider = FeatureGroup("visits", "who", (*FG.features, Feature("score", "float64")), entity_dtype="int64")
    write(spark, root, "a", batch(1))
    rows = spark.createDataFrame(batch(2), KIND).withColumn("score", F.lit(0.5))
    offline.write_features(wider, rows, root, batch="b")
    for _ in range(2):
        found = offline.read_features(spark, wider, root, keep=["note"])
        assert {(r._ingest_ts, r.score, r.note) for r in found.collect()} == {(1, None, "s1"), (2, 0.5, "s2")}
        cm.compact_features(spark, wider, root)


def test_dates_are_pruned_in_packs(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        write(spark, root, f"b{i}", batch(i))
    cm.compact_features(spark, FG, root)
    last = str((T0 + timedelta(days=1)).date())
    wanted = expected(*[[r for r in batch(i) if str(r[3].date()) <= last] for i in range(3)])
    assert read(spark, root, until=last) == wanted
    plan = offline.read_features(spark, FG, root, until=last)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


@pytest.mark.parametrize("rows", [[], None])
def test_tables_without_rows(spark, tmp_path, rows):
    root = str(tmp_path)
    if rows is not None:
        write(spark, root, "a", rows)
    cm.compact_features(spark, FG, root)
    assert offline.read_features(spark, FG, root).count() == 0
    cm.vacuum_features(spark, FG, root)
    write(spark, root, "z", batch(3))
    assert read(spark, root) == expected(batch(3))
