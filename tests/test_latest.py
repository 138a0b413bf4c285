import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureGroup, ModelVersion
from tidemark.functions.codec import decode, encode
from tidemark.operators import latest as lv
from tidemark.streaming import state

T0 = datetime(2021, 2, 28, 23, 50)
GROUP = FeatureGroup(
    "rig_state",
    "rig",
    (
        Feature("phase", "string"),
        Feature("wear", "int64", default_value=12),
        Feature("trace", "float_list", default_value=[0.0, 1.5]),
        Feature("sealed", "bool", default_value=False),
        Feature("noise", "float64", default_value=0.25),
    ),
    version=4,
)
WRITES = (
    "rig string, phase string, wear long, trace array<double>, sealed boolean, noise double, "
    "_event_ts timestamp_ntz, _write_ts timestamp_ntz, _seq long"
)
# Fields of a write in the order of its tuple; a trace follows from the noise.
NAMES = ["wear", "noise", "sealed", "phase"]


def write(spark, rows):
    made = [
        (rig, phase, wear, None if noise is None else [noise, -noise], sealed, noise, event, at, seq)
        for rig, wear, noise, sealed, phase, event, at, seq in rows
    ]
    return spark.createDataFrame(made, WRITES)


def one(spark, rows, **options):
    return {r.rig: r for r in lv.latest_view(GROUP, write(spark, rows), **options).collect()}


def test_text_form_gives_every_type_back(spark):
    """Whatever mix of fields a write carries, encoding and decoding its record changes
    nothing; what it lacks comes back as the default."""
    present = [[bool(mask >> i & 1) for i in range(4)] for mask in range(16)]
    rows = []
    for k, (w, n, c, p) in enumerate(present):
        rows.append((f"r{k}", -(2**62) + k if w else None, k / 3 if n else None, bool(k & 4) if c else None, "" if p else None, T0 - timedelta(microseconds=k), T0, k))
    back = decode(GROUP, encode(GROUP, lv.latest_view(GROUP, write(spark, rows)))).collect()
    assert len(back) == 16
    for r in back:
        k = int(r.key.removeprefix("ff:{rig_state:r").removesuffix("}:v4"))
        w, n, c, p = present[k]
        assert r.wear == (-(2**62) + k if w else 12) and r.noise == (k / 3 if n else 0.25)
        assert r.sealed == (bool(k & 4) if c else False) and r.phase == ("" if p else None)
        assert r.trace == ([k / 3, -k / 3] if n else [0.0, 1.5])
        assert r._event_ts == T0 - timedelta(microseconds=k)


def test_lookup_gives_each_asked_rig_one_row(spark):
    """Asked in any order, any number of times, with or without a record."""
    held = [(f"r{k}", k, None, None, None, T0 + timedelta(hours=k), T0, k) for k in range(0, 30, 3)]
    asked = [(f"r{k % 23}",) for k in range(50)]
    view = lv.latest_view(GROUP, write(spark, held))
    found = lv.lookup_latest(GROUP, spark.createDataFrame(asked, "rig string"), view).collect()
    assert sorted(r.rig for r in found) == sorted({a for a, in asked})
    for r in found:
        k = int(r.rig[1:])
        assert (r.wear, r._event_ts) == ((k, T0 + timedelta(hours=k)) if k % 3 == 0 else (12, None))
        assert (r.noise, r.sealed, r.phase, r.trace) == (0.25, False, None, [0.0, 1.5])


def test_chosen_features_and_columns_outside_the_spec(spark):
    view = lv.latest_view(GROUP, write(spark, [("r", 5, None, True, None, T0, T0, 1)])).withColumn("stray", F.lit(2.5))
    row = lv.select_features(GROUP, view, ["stray", "sealed", "unheard", "noise"]).first()
    assert row.asDict() == {"rig": "r", "stray": "2.5", "sealed": True, "unheard": None, "noise": 0.25, "_event_ts": T0}
    assert lv.select_features(GROUP, view, None).columns == ["rig", *GROUP.feature_names, "_event_ts"]


def test_fields_merge_and_late_event_overwrites(spark):
    late = T0 - timedelta(days=3)
    rows = [
        ("u", 1, 2.0, None, None, T0, T0, 1),
        ("u", 9, None, None, "idle", late, T0 + timedelta(seconds=1), 2),
        ("u", None, None, None, None, None, T0 + timedelta(seconds=2), 3),
    ]
    by_arrival = one(spark, rows[:2])["u"]
    assert (by_arrival.wear, by_arrival.noise) == (9, 2.0)
    assert by_arrival._event_ts == late
    by_event = one(spark, rows[:2], order="event_time")["u"]
    assert (by_event.wear, by_event.phase, by_event._event_ts) == (1, "idle", T0)
    # A write without event time happened when it was written.
    assert one(spark, rows)["u"]._event_ts == T0 + timedelta(seconds=2)
    with pytest.raises(ValueError):
        one(spark, rows, order="other")


def simulate(rows, ttl, as_of):
    store = {}
    for r in sorted(rows, key=lambda r: r[-1]):
        user, now = r[0], r[6]
        old = store.get(user)
        if old and ttl > 0 and old["expires"] <= now:
            old = None
        rec = old or {"v": {}}
        for name, value in zip(NAMES, r[1:5], strict=True):
            if value is not None:
                rec["v"][name] = value
        rec["ts"], rec["expires"] = r[5], now + timedelta(seconds=ttl)
        store[user] = rec
    return {
        u: ([rec["v"].get(n) for n in NAMES], rec["ts"])
        for u, rec in store.items()
        if ttl <= 0 or rec["expires"] > as_of
    }


def random_writes(seed, n=400):
    rng = random.Random(seed)
    now, rows = T0, []
    for i in range(n):
        now += timedelta(seconds=rng.choice([1, 10, 60, 100, 300]))
        rows.append(
            (
                rng.choice(["a", "b", "c", "d", "hot", "hot"]),
                rng.choice([None, i]),
                rng.choice([None, i / 2]),
                rng.choice([None, True, False]),
                rng.choice([None, "x", "y"]),
                now - timedelta(seconds=rng.randrange(500)),
                now,
                i,
            )
        )
    return rows


@pytest.mark.parametrize("ttl", [0, 60, 300, 400, 1000])
def test_expiry_against_simulation(spark, ttl):
    rows = random_writes(ttl)
    fg = FeatureGroup("rig_state", "rig", GROUP.features, ttl_seconds=ttl)
    as_of = rows[-1][6] + timedelta(seconds=50)
    found = lv.latest_view(fg, write(spark, rows), as_of=as_of).collect()
    got = {r.rig: ([r[n] for n in NAMES], r._event_ts) for r in found}
    assert got == simulate(rows, ttl, as_of)


def test_session_zone_does_not_matter(spark):
    """Two writes an hour apart across a daylight-saving gap of the session's zone."""
    before, after = datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 3, 0)
    rows = [
        ("u", 1, None, None, None, before, before, 1),
        ("u", None, 2.0, None, None, after, after, 2),
    ]
    fg = FeatureGroup("rig_state", "rig", GROUP.features, ttl_seconds=3600 + 1000)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = lv.latest_view(fg, write(spark, rows), as_of=after).first()
        assert (row.wear, row.noise) == (None, 2.0)
        assert row._event_ts == after
        exported = encode(fg, lv.latest_view(fg, write(spark, rows))).first().fields
        assert float(exported["_event_ts"]) == 1710039600.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_expiry_is_exclusive_at_the_end(spark):
    rows = [("u", 1, None, None, None, T0, T0, 1)]
    day = timedelta(days=1)
    assert one(spark, rows, as_of=T0 + day - timedelta(microseconds=1))
    assert not one(spark, rows, as_of=T0 + day)


def test_incremental_state_equals_batch(spark, tmp_path):
    rows = random_writes(3)
    fg = FeatureGroup("rig_state", "rig", GROUP.features, ttl_seconds=400)
    path = str(tmp_path / "state")
    as_of = rows[-1][6]
    for b in range(0, 400, 100):
        part = write(spark, rows[b : b + 100])
        state.add_writes(fg, part, path, f"b{b:04d}")
        state.add_writes(fg, part, path, f"b{b:04d}")  # a replay replaces
        if b in (100, 200):
            state.compact(spark, fg, path)
        want = lv.latest_view(fg, write(spark, rows[: b + 100]), as_of=rows[b + 99][6])
        got = state.read_latest(spark, fg, path, as_of=rows[b + 99][6])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.rig for r in got.collect()} == set(simulate(rows, 400, as_of))
    with pytest.raises(FileNotFoundError):
        state.read_latest(spark, fg, str(tmp_path / "nothing"))


def test_views_of_batch_and_state_agree(spark, tmp_path):
    path = str(tmp_path / "state")
    pause = T0 + timedelta(days=2)
    rows = [("a", 1, 2.0, None, None, T0, T0, 1), ("a", None, 3.0, None, None, pause, pause, 2)]
    state.add_writes(GROUP, write(spark, rows), path, "s-0")
    for as_of in (None, pause + timedelta(hours=1), pause + timedelta(days=3)):
        batch = lv.latest_view(GROUP, write(spark, rows), as_of=as_of)
        assert rows_of(batch) == rows_of(state.read_latest(spark, GROUP, path, as_of=as_of))
    assert lv.latest_view(GROUP, write(spark, rows)).first().wear is None
    assert lv.latest_view(GROUP, write(spark, rows), expire=False).first().wear == 1


def rows_of(df):
    return sorted(str(r) for r in df.collect())


def test_compaction_folds_and_vacuum_removes(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = random_writes(8, 90)
    for b in range(3):
        state.add_writes(GROUP, write(spark, rows[30 * b : 30 * b + 30]), path, f"s-{b:06d}")
        if b == 1:
            assert state.compact(spark, GROUP, path) == 1
    late = [("new", 1, 1.0, True, "x", T0, T0, 1)]
    state.add_writes(GROUP, write(spark, late), path, "a-other-stream")
    want = rows_of(lv.latest_view(GROUP, write(spark, rows + late), expire=True))
    assert rows_of(state.read_latest(spark, GROUP, path)) == want
    state.vacuum(spark, path)
    assert not (tmp_path / "state/delta/batch=s-000000").exists()
    assert (tmp_path / "state/delta/batch=s-000002").exists()
    assert rows_of(state.read_latest(spark, GROUP, path)) == want
    # A batch that was folded and removed may be replayed.
    state.add_writes(GROUP, write(spark, rows[:30]), path, "s-000000")
    assert rows_of(state.read_latest(spark, GROUP, path)) == want
    assert state.compact(spark, GROUP, path) == 2
    state.vacuum(spark, path)
    assert rows_of(state.read_latest(spark, GROUP, path)) == want


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    path = str(tmp_path / "state")
    many = [(f"d{i}", i, None, None, None, T0, T0, i) for i in range(200)]
    state.add_writes(GROUP, write(spark, many), path, "s-0")
    state.compact(spark, GROUP, path)
    state.add_writes(GROUP, write(spark, [("d7", 999, None, None, None, T0, T0, 999)]), path, "s-1")
    state.compact(spark, GROUP, path)
    assert len([p for p in (tmp_path / "state/base/gen=2").iterdir() if p.is_dir()]) == 1
    found = {r.rig: r.wear for r in state.read_latest(spark, GROUP, path).collect()}
    assert len(found) == 200 and found["d7"] == 999 and found["d8"] == 8


def test_unfinished_batches_are_invisible(spark, tmp_path):
    path = str(tmp_path / "state")
    state.add_writes(GROUP, write(spark, [("a", 1, None, None, None, T0, T0, 1)]), path, "s-0")
    half = lv.partial_rows(GROUP, write(spark, [("b", 2, None, None, None, T0, T0, 2)]))
    half.write.parquet(f"{path}/delta/batch=s-1")
    assert {r.rig for r in state.read_latest(spark, GROUP, path).collect()} == {"a"}
    state.compact(spark, GROUP, path)
    both = [("b", 2, None, None, None, T0, T0, 2), ("c", 3, None, None, None, T0, T0, 3)]
    state.add_writes(GROUP, write(spark, both), path, "s-1")
    assert {r.rig for r in state.read_latest(spark, GROUP, path).collect()} == {"a", "b", "c"}


def test_state_of_empty_batches(spark, tmp_path):
    path = str(tmp_path / "state")
    state.add_writes(GROUP, write(spark, []), path, "s-0")
    for number in (1, 2):
        assert state.compact(spark, GROUP, path) == number
    state.add_writes(GROUP, write(spark, [("a", 1, None, None, None, T0, T0, 1)]), path, "s-1")
    assert state.read_latest(spark, GROUP, path).first().wear == 1


def test_a_later_write_with_a_lower_offset_wins(spark, tmp_path):
    path = str(tmp_path / "state")
    later = T0 + timedelta(seconds=50)
    first, second = ("a", 1, None, None, "old", T0, T0, 900), ("a", 2, None, None, None, T0, later, 3)
    state.add_writes(GROUP, write(spark, [first]), path, "s-0")
    state.add_writes(GROUP, write(spark, [second]), path, "t-0")
    for view in (state.read_latest(spark, GROUP, path), lv.latest_view(GROUP, write(spark, [second, first]))):
        row = view.first()
        assert (row.wear, row.phase) == (2, "old")


def test_state_follows_an_added_feature(spark, tmp_path):
    path = str(tmp_path / "state")
    kept = tuple(f for f in GROUP.features if f.name in ("wear", "noise"))
    old = FeatureGroup("rig_state", "rig", kept, version=GROUP.version)
    state.add_writes(old, write(spark, [("u", 1, 1.0, None, None, T0, T0, 1)]), path, "s-000000")
    first = state.read_latest(spark, GROUP, path).first()
    assert (first.wear, first.sealed) == (1, None)
    state.compact(spark, old, path)
    state.add_writes(GROUP, write(spark, [("u", 2, None, True, "x", T0, T0, 2)]), path, "s-000001")
    row = state.read_latest(spark, GROUP, path).first()
    assert [row[n] for n in NAMES] == [2, 1.0, True, "x"]


def test_codec_edge_values(spark):
    fg = FeatureGroup(
        "edge",
        "id",
        (
            Feature("i", "int64"),
            Feature("d", "float64"),
            Feature("b", "bool"),
            Feature("l", "float_list", default_value=[1.0]),
            Feature("s", "string"),
        ),
    )
    df = spark.createDataFrame(
        [("x", 5, 5.0, False, [], "", T0), ("y", None, None, None, None, None, T0)],
        "id string, i long, d double, b boolean, l array<double>, s string, _event_ts timestamp_ntz",
    )
    encoded = encode(fg, df)
    fields = {r.key: r.fields for r in encoded.collect()}
    assert fields["ff:{edge:x}:v1"]["b"] == "0" and fields["ff:{edge:x}:v1"]["l"] == "[]"
    assert set(fields["ff:{edge:y}:v1"]) == {"_event_ts"}
    back = {r.key: r for r in decode(fg, encoded).collect()}
    x, y = back["ff:{edge:x}:v1"], back["ff:{edge:y}:v1"]
    assert (x.i, x.d, x.b, x.l, x.s) == (5, 5.0, False, [], "")
    assert (y.i, y.d, y.b, y.l, y.s) == (None, None, None, [1.0], None)
    bad = spark.createDataFrame([("k", {"i": "5.5x", "d": "?", "b": "1"})], "key string, fields map<string,string>")
    row = decode(fg, bad, names=["i", "d", "b", "other"]).first()
    assert (row.i, row.d, row.b, row.other, row._event_ts) == (None, None, True, None, None)


def test_features_for_model(spark):
    view = lv.latest_view(GROUP, write(spark, [("u1", 5, 1.0, True, "run", T0, T0, 1)]))
    other = FeatureGroup("other", "uid", (Feature("z", "int64", default_value=-1),))
    z = spark.createDataFrame([("u2", 3, T0)], "uid string, z long, _event_ts timestamp_ntz")
    requests = spark.createDataFrame([("u1", 1), ("u2", 2), ("u1", 3), (None, 4)], "entity_id string, r int")
    model = ModelVersion("m", 1, ("rig_state", "gone", "other"))
    features = lv.features_for_model(
        model, requests, {"rig_state": (GROUP, view), "other": (other, z)}, "entity_id"
    )
    for hot_rows in (2, 10):
        rows = {r.r: r for r in lv.attach_features(requests, features, "entity_id", hot_rows).collect()}
        assert [(rows[i].wear, rows[i].z) for i in (1, 2, 3)] == [(5, -1), (12, 3), (5, -1)]
        assert len(rows) == 4
    clash = FeatureGroup("clash", "uid", (Feature("wear", "int64"),))
    with pytest.raises(ValueError, match="several groups"):
        lv.features_for_model(
            ModelVersion("m", 1, ("rig_state", "clash")),
            requests,
            {"rig_state": (GROUP, view), "clash": (clash, view.withColumn("uid", F.lit("u")))},
            "entity_id",
        )


def test_busy_entity_with_a_short_ttl(spark):
    """One second of ttl over hours of writes: cells are merged chunk by chunk."""
    draw, at, rows = random.Random(5), 0, []
    fg = FeatureGroup("pulse", "id", (Feature("a", "int64"), Feature("b", "int64")), ttl_seconds=1)
    for i in range(3000):
        at += draw.choice([100_000, 400_000, 900_000, 999_999, 999_999, 1_000_000 if draw.random() < 0.01 else 5, 8_000_000_000 if draw.random() < 0.002 else 1])
        rows.append(("hot" if draw.random() < 0.9 else f"u{i % 3}", draw.choice([None, i]), draw.choice([None, None, i]), at, i))
    df = spark.createDataFrame(rows, "id string, a long, b long, at long, _seq long")
    writes = df.select("id", "a", "b", "_seq", F.timestamp_add("MICROSECOND", "at", F.lit("2024-01-01").cast("timestamp_ntz")).alias("_write_ts"))
    writes = writes.withColumn("_event_ts", F.col("_write_ts"))
    wanted = {}
    for who, a, b, t, _ in rows:
        old = wanted.get(who)
        held = {} if old is None or t - old["t"] >= 1_000_000 else old
        wanted[who] = held | {k: v for k, v in (("a", a), ("b", b)) if v is not None} | {"t": t}
    for cells in (2, 64, lv.CHUNK_CELLS):
        before, lv.CHUNK_CELLS = lv.CHUNK_CELLS, cells
        try:
            found = {r.id: (r.a, r.b) for r in lv.latest_view(fg, writes).collect()}
        finally:
            lv.CHUNK_CELLS = before
        assert found == {k: (v.get("a"), v.get("b")) for k, v in wanted.items()}
