import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Feature, FeatureGroup
from tidemark.operators import transform as tf
from tidemark.operators.rolling import rolling_features
from tidemark.sources import messages as ms
from tidemark.sources import offline
from tidemark.sources.synth import Draw, synth_features
from tidemark.streaming import ingest, state
from tidemark.workspace import shared_dir

FG = FeatureGroup(
    "clicks", "uid", (Feature("n", "int64", default_value=0), Feature("page", "string"), Feature("never", "bool"))
)
MESSAGE = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("page", T.StringType()),
        T.StructField("ts", T.DoubleType()),
    ]
)
RAW = "value string, offset long, at timestamp_ntz"
T0 = datetime(2023, 11, 14, 22, 13, 20)


def record(msg):
    return tf.Record(
        entity=msg["uid"],
        values={"n": msg["n"], "page": msg["page"], "unknown": F.lit(1)},
        event_ts=msg["ts"],
        keep=msg["n"] >= 0,
    )


def raw(start, texts):
    return [(t, start + i, T0 + timedelta(seconds=start + i)) for i, t in enumerate(texts)]


def text(uid="u", n=1, ts=1_700_000_000.5, **more):
    return json.dumps({"uid": uid, "n": n, "ts": ts} | more)


FIRST = raw(0, [text(), text("v", 2, page="p"), "{broken", text(n=-1), text(uid=None), "[1]"])
SECOND = raw(6, [text("u", 7), text("w", 3), json.dumps({"uid": "x", "n": 1}), ""])


def parsed(df):
    return ms.parse_messages(df, MESSAGE, seq=F.col("offset"), write_ts=F.col("at"))


def test_transform_statuses(spark):
    rows = tf.apply_transform(FG, parsed(spark.createDataFrame(FIRST + SECOND, RAW)), record)
    status = {r._seq: r._status for r in rows.collect()}
    errors = {2, 4, 5, 8, 9}
    assert status == {i: "error" if i in errors else "skipped" if i == 3 else "ok" for i in range(10)}
    good = tf.accepted(FG, rows).orderBy("_seq").first()
    assert (good.uid, good.n, good.page, good.never) == ("u", 1, None, None)
    assert good._event_ts == T0 + timedelta(seconds=0.5)
    stats = tf.ingest_stats(rows).first()
    assert stats.asDict() == {
        "partition": 0,
        "messages_consumed": 10,
        "rows_written_online": 4,
        "rows_written_offline": 4,
        "skipped": 1,
        "errors": 5,
        "last_offset": 9,
    }
    lost = {r._seq: (r._raw, r._reason) for r in tf.dead_letters(rows).collect()}
    assert lost == {
        2: ("{broken", "not parsed"),
        4: (text(uid=None), "no entity"),
        5: ("[1]", "not parsed"),
        8: (json.dumps({"uid": "x", "n": 1}), "no event time"),
        9: ("", "not parsed"),
    }


def test_no_time_stops_a_batch(spark):
    schema = T.StructType([*MESSAGE.fields[:-1], T.StructField("ts", T.StringType())])
    times = ["1e300", "NaN", "yesterday", "-1e14", "1700000000"]
    rows = raw(0, [text(ts=t) for t in times])
    parsed_ = ms.parse_messages(spark.createDataFrame(rows, RAW), schema, seq=F.col("offset"), write_ts=F.col("at"))
    found = tf.apply_transform(FG, parsed_, record).orderBy("_seq").collect()
    assert [r._status for r in found] == ["error"] * 4 + ["ok"]
    assert {r._reason for r in found[:4]} == {"event time out of range"} and all(r._raw for r in found)


def test_callback_errors_concern_one_message(spark):
    def made(message):
        if message["n"] < 0:
            return None
        return {"entity": message["uid"], "values": {"n": 100 // message["n"], "page": "p", "never": True}, "event_ts": message["ts"]}

    rows = raw(0, [text(n=4), text(n=0), text(n=-1), "{", text(uid=None), text("v", 50)])
    found = tf.apply_transform(FG, parsed(spark.createDataFrame(rows, RAW)), tf.Callback(made)).orderBy("_seq").collect()
    assert [r._status for r in found] == ["ok", "error", "skipped", "error", "error", "ok"]
    assert found[1]._reason.startswith("ZeroDivisionError")
    assert [(r.uid, r.n, r.page, r.never) for r in (found[0], found[5])] == [("u", 25, "p", True), ("v", 2, "p", True)]


def test_last_offset_of_each_partition(spark):
    rows = tf.apply_transform(FG, parsed(spark.createDataFrame(FIRST + SECOND, RAW)), record)
    stats = tf.ingest_stats(rows.withColumn("partition", F.col("_seq") % 2)).collect()
    assert {r.partition: (r.messages_consumed, r.last_offset) for r in stats} == {0: (5, 8), 1: (5, 9)}


@pytest.fixture
def job(tmp_path):
    paths = {k: str(tmp_path / k) for k in ("root", "state_path", "stats_path", "dead_letter_path")}
    return ingest.Ingest(FG, record, name="test", **paths)


def test_stream_equals_batch_and_resumes(spark, tmp_path, job):
    source = tmp_path / "in"
    for part in (FIRST, SECOND):
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(RAW).parquet(str(source))
        query = ingest.start_ingest(
            parsed(stream), job, str(tmp_path / "checkpoint"), available_now=True
        )
        query.awaitTermination()
    stored = offline.read_features(spark, FG, job.root)
    assert sorted((r.uid, r.n) for r in stored.collect()) == [("u", 1), ("u", 7), ("v", 2), ("w", 3)]
    latest = {r.uid: r.n for r in state.read_latest(spark, FG, job.state_path).collect()}
    assert latest == {"u": 7, "v": 2, "w": 3}
    stats = ingest.read_stats(spark, job).first()
    assert (stats.messages_consumed, stats.rows_written_offline, stats.errors) == (10, 4, 5)
    assert spark.read.parquet(job.dead_letter_path).count() == 5


def test_replay_leaves_no_duplicates(spark, job):
    messages = parsed(spark.createDataFrame(FIRST, RAW))
    for _ in range(2):
        ingest.ingest_batch(messages, job, batch_id=3)
    assert offline.read_features(spark, FG, job.root).count() == 2
    assert ingest.read_stats(spark, job).first().messages_consumed == 6


def test_batch_without_good_rows(spark, job):
    ingest.ingest_batch(parsed(spark.createDataFrame(raw(0, ["{"]), RAW)), job)
    assert state.read_latest(spark, FG, job.state_path).count() == 0
    assert ingest.read_stats(spark, job).first().errors == 1


def test_stream_repeats_are_dropped(spark, tmp_path):
    spark.createDataFrame(FIRST[:2] + FIRST[:2], RAW).write.parquet(str(tmp_path / "in"))
    stream = parsed(spark.readStream.schema(RAW).parquet(str(tmp_path / "in")))
    unique = ingest.drop_repeats(stream, ["_seq"], "_write_ts", "1 hour")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    query = unique.writeStream.format("parquet").option("checkpointLocation", ckpt)
    query.trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_kafka_source_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        ms.read_kafka(spark, {"subscribe": "t", "kafka.bootstrap.servers": "x:1"}, MESSAGE)


def test_shared_dir_prefers_the_clusters(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured.rstrip("/")


def test_rolling_features(spark):
    day = datetime(2024, 1, 1)
    rows = [
        ("u", day, "login", None),
        ("u", day + timedelta(days=1), "session", 10.0),
        ("u", day + timedelta(days=1), "session", 20.0),
        ("u", day + timedelta(days=40), "share", None),
        ("v", day, "share", None),
    ]
    df = spark.createDataFrame(rows, "e string, ts timestamp, kind string, secs double")
    found = rolling_features(
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")),
        "e",
        "ts",
        F.col("kind") == "login",
        F.col("secs"),
        F.col("kind"),
    )
    got = {(r.e, r.day.day, r.day.month): tuple(r)[2:] for r in found.collect()}
    assert got == {
        ("u", 1, 1): (1, 0.0, 0, 1),
        ("u", 2, 1): (1, 15.0, 1, 2),
        ("u", 10, 2): (0, 0.0, 40, 1),
        ("v", 1, 1): (0, 0.0, 999, 1),
    }


def test_synthetic_features(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("u_"), F.col("id").cast("string")).alias("uid"))
    rows = synth_features(ids, "uid", "2024-01-31 00:00:00", seed=7)
    s = rows.agg(
        F.avg("visits"), F.avg("minutes"), F.avg("idle_days"), F.min("_event_ts"),
        F.max("_event_ts"), F.avg("leaves"), F.max("idle_days"),
    ).first()
    assert s[0] == pytest.approx(4, abs=0.07) and s[1] == pytest.approx(25, rel=0.04)
    assert s[2] == pytest.approx(29.5, abs=0.7) and s[6] == 59
    assert s[3] > datetime(2024, 1, 30) - timedelta(seconds=1) and s[4] <= datetime(2024, 1, 31)
    assert 0.05 < s[5] < 0.6
    own = synth_features(ids, "uid", "2024-01-31", {"x": Draw("below", 2)}, label=None)
    assert own.columns == ["uid", "x", "_event_ts"] and {r.x for r in own.select("x").distinct().collect()} == {0, 1}
    again = synth_features(ids.repartition(13), "uid", "2024-01-31 00:00:00", seed=7)
    assert rows.exceptAll(again).isEmpty()
