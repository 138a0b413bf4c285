"""Named queries over the test tables, one per operator.

Each takes a session and a folder of parquet tables and returns a flat DataFrame.
Inputs are the given tables or tables Spark derives from them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codec import decode, encode
from tidemark.functions.hashing import canary_bucket
from tidemark.functions.timefns import age_seconds, ntz_to_micros
from tidemark.operators import drift, modelstore, registry, rolling, routing, scoring, servelog, sketches, sweep
from tidemark.operators import latest as lv
from tidemark.operators import quantiles as quantiles_module
from tidemark.operators import transform as tf
from tidemark.operators.pit import Keyed, point_in_time_join, point_in_time_join_keys
from tidemark.operators.quantiles import quantile_edges
from tidemark.plans.serving import serve, serve_at_request
from tidemark.plans.training import training_set
from tidemark.sources import messages as ms
from tidemark.sources import compaction, offline
from tidemark.sources.kv import apply_changes, export_changes, export_kv
from tidemark.sources.synth import synth_features
from tidemark.spec import (
    CANARY,
    EVENT_TS,
    PRODUCTION,
    SEQ,
    SHADOW,
    WRITE_TS,
    Feature,
    FeatureGroup,
    FeatureType,
    ModelVersion,
)
from tidemark.streaming import ingest, progress, state, stateful
from tidemark.workspace import new_run_dir

SPLIT = "2024-01-15"
AS_OF = "2024-01-31 00:00:00"
TYPES = ["click", "error", "purchase", "signup", "view"]

F64, I64 = FeatureType.FLOAT64, FeatureType.INT64
TEXT, BOOL = FeatureType.STRING, FeatureType.BOOL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


# ---- point-in-time joins ---------------------------------------------------


def event_group(name: str) -> FeatureGroup:
    return FeatureGroup(
        f"{name}s", "user_id", (Feature(f"{name}_value", F64),), entity_dtype=I64
    )


def event_features(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = events(spark, sf).filter(F.col("event_type") == name)
    return rows.select(
        "user_id", F.col("ts").alias(EVENT_TS), F.col("value").alias(f"{name}_value")
    )


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).filter(F.col("event_type") == "purchase")
    return rows.select("event_id", "user_id", F.col("ts").alias("event_ts"))


def pit_join(spark: SparkSession, sf: str) -> DataFrame:
    groups = [(event_group("click"), event_features(spark, sf, "click"))]
    return point_in_time_join(purchases(spark, sf), groups, "user_id")


def pit_join_multi(spark: SparkSession, sf: str) -> DataFrame:
    groups = [(event_group(n), event_features(spark, sf, n)) for n in ("click", "error", "view")]
    return point_in_time_join(purchases(spark, sf), groups, "user_id")


def pit_join_ties(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    fg = FeatureGroup(
        "orders",
        "o_custkey",
        (Feature("o_totalprice", F64), Feature("last_order", I64)),
        entity_dtype=I64,
    )
    features = orders.select(
        "o_custkey",
        F.col("o_orderdate").alias(EVENT_TS),
        "o_totalprice",
        F.col("o_orderkey").alias("last_order"),
        F.col("o_orderkey").alias("_ingest_ts"),
    )
    spine = orders.select(
        "o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("event_ts")
    )
    return point_in_time_join(spine, [(fg, features)], "cust")


def pit_join_skew(spark: SparkSession, sf: str) -> DataFrame:
    """Every user with 20 rows counts as hot, so the chunked path answers."""
    groups = [(event_group("click"), event_features(spark, sf, "click"))]
    return point_in_time_join(purchases(spark, sf), groups, "user_id", hot_rows=20)


def training_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """Write a group, read it back pruned, and join it to the labels."""
    root = new_run_dir(spark, "training")
    fg = event_group("click")
    offline.write_features(fg, event_features(spark, sf, "click"), root)
    return training_set(spark, purchases(spark, sf), [fg], root, "user_id")


#: Days that orders are moved by, to lie among the events.
ORDER_SHIFT = 9500
CUSTOMER_ORDERS = FeatureGroup(
    "orders", "o_custkey", (Feature("o_totalprice", F64), Feature("o_orderstatus", TEXT)), entity_dtype=I64
)


def pit_join_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that name a user and a customer, joined with clicks and views by user and orders
    by customer. Some labels have no customer."""
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        F.timestamp_add("DAY", F.lit(ORDER_SHIFT), F.col("o_orderdate").cast("timestamp_ntz")).alias(EVENT_TS),
        "o_totalprice",
        "o_orderstatus",
        F.col("o_orderkey").alias("_ingest_ts"),
    )
    customer = F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 150 + 1)
    spine = purchases(spark, sf).withColumn("customer", customer)
    groups = [Keyed("customer", CUSTOMER_ORDERS, orders)]
    groups += [Keyed("user_id", event_group(n), event_features(spark, sf, n)) for n in ("click", "view")]
    return point_in_time_join_keys(spine, groups)


# ---- offline tables --------------------------------------------------------

EVENT_LOG = FeatureGroup(
    "event_log",
    "user_id",
    (Feature("event_id", I64), Feature("event_type", TEXT), Feature("value", F64)),
    entity_dtype=I64,
)
EVENT_LOG_EVOLVED = FeatureGroup(
    "event_log", "user_id", (*EVENT_LOG.features, Feature("k", I64)), entity_dtype=I64
)


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "user_id", F.col("ts").alias(EVENT_TS), "event_id", "event_type", "value", k_of().alias("k")
    )


def offline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = new_run_dir(spark, "roundtrip")
    offline.write_features(EVENT_LOG, event_log(spark, sf).drop("k"), root)
    return offline.read_features(spark, EVENT_LOG, root).drop("_ingest_ts")


def evolved_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The first half is written before the feature ``k`` exists."""
    root = new_run_dir(spark, "evolved")
    rows = event_log(spark, sf)
    old, new = F.col(EVENT_TS) < F.lit(SPLIT), F.col(EVENT_TS) >= F.lit(SPLIT)
    offline.write_features(EVENT_LOG, rows.filter(old).drop("k"), root)
    offline.write_features(EVENT_LOG_EVOLVED, rows.filter(new), root)
    return offline.read_features(spark, EVENT_LOG_EVOLVED, root).drop("_ingest_ts")


def compacted_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Five batches folded into packs; then one of them is written again, a sixth comes, and
    both are folded."""
    root = new_run_dir(spark, "compacted")
    rows = event_log(spark, sf).drop("k")
    part = F.pmod(F.col("event_id"), F.lit(6))
    for i in range(5):
        # The second batch is wrong at first: it has rows of others, and lacks its own.
        mine = part == i if i != 1 else part == 0
        offline.write_features(EVENT_LOG, rows.filter(mine), root, batch=f"b{i}")
    compaction.compact_features(spark, EVENT_LOG, root)
    compaction.vacuum_features(spark, EVENT_LOG, root)
    offline.write_features(EVENT_LOG, rows.filter(part == 1), root, batch="b1")
    offline.write_features(EVENT_LOG, rows.filter(part == 5), root, batch="b5")
    compaction.compact_features(spark, EVENT_LOG, root)
    return offline.read_features(spark, EVENT_LOG, root).drop("_ingest_ts")


def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns a batch lacks, as the writer refuses it: all events as batches that have
    lost two columns."""
    rows = event_log(spark, sf).drop("k", "value", EVENT_TS)
    try:
        offline.write_features(EVENT_LOG, rows, new_run_dir(spark, "missing"))
        refused = ""
    except ValueError as error:
        refused = str(error)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


def dedup_features(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch delivered twice under different labels."""
    root = new_run_dir(spark, "dedup")
    for label in ("first", "again"):
        offline.write_features(EVENT_LOG, event_log(spark, sf).drop("k"), root, batch=label)
    stored = offline.read_features(spark, EVENT_LOG, root)
    return offline.dedup_features(stored).drop("_ingest_ts")


def replay_fewer_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A batch is written, and then again with its later dates only."""
    root = new_run_dir(spark, "replay")
    rows = event_log(spark, sf).drop("k")
    offline.write_features(EVENT_LOG, rows, root, batch="one")
    offline.write_features(EVENT_LOG, rows.filter(F.col(EVENT_TS) >= F.lit(SPLIT)), root, batch="one")
    return offline.read_features(spark, EVENT_LOG, root).drop("_ingest_ts")


def evolution_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Specs that retype or remove a stored feature are refused; the table stays as it was."""
    root = new_run_dir(spark, "evolution")
    rows = event_log(spark, sf).drop("k")
    offline.write_features(EVENT_LOG, rows, root)
    first, _, last = EVENT_LOG.features
    removed = FeatureGroup("event_log", "user_id", (first, last), entity_dtype=I64)
    retyped = FeatureGroup("event_log", "user_id", (first, Feature("event_type", I64), last), entity_dtype=I64)
    refused = 0
    for fg, batch in ((removed, rows.drop("event_type")), (retyped, rows.withColumn("event_type", F.lit(1)))):
        try:
            offline.write_features(fg, batch, root)
        except ValueError:
            refused += 1
    return offline.read_features(spark, EVENT_LOG, root).drop("_ingest_ts").withColumn("refused", F.lit(refused))


# ---- latest values ---------------------------------------------------------

ACTIVITY = FeatureGroup(
    "activity",
    "user_id",
    (
        *[Feature(t, F64, default_value=0.0) for t in TYPES],
        Feature("last_k", I64, default_value=0),
        Feature("last_type", TEXT, default_value="unknown"),
        Feature("is_big", BOOL, default_value=False),
    ),
    ttl_seconds=2 * 86400,
    entity_dtype=I64,
)


def sparse_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Each event writes the field named after its type, and a field no spec knows."""
    values = F.create_map(
        F.col("event_type"),
        F.col("value").cast("string"),
        F.lit("last_k"),
        k_of().cast("string"),
        F.lit("last_type"),
        F.col("event_type"),
        F.lit("is_big"),
        F.when(F.col("value") > 100, "1").otherwise("0"),
        F.lit("not_in_spec"),
        F.lit("x"),
    )
    return events(spark, sf).select(
        "user_id",
        values.alias("values"),
        F.col("ts").alias(EVENT_TS),
        F.col("ts").alias(WRITE_TS),
        F.col("event_id").alias(SEQ),
    )


def wide_writes(spark: SparkSession, sf: str) -> DataFrame:
    return writes_of(events(spark, sf))


def writes_of(rows: DataFrame) -> DataFrame:
    own = [F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in TYPES]
    return rows.select(
        "user_id",
        *own,
        k_of().alias("last_k"),
        F.col("event_type").alias("last_type"),
        (F.col("value") > 100).alias("is_big"),
        F.col("ts").alias(EVENT_TS),
        F.col("ts").alias(WRITE_TS),
        F.col("event_id").alias(SEQ),
    )


def latest_view(spark: SparkSession, sf: str) -> DataFrame:
    return lv.latest_view(ACTIVITY, lv.from_sparse(ACTIVITY, sparse_writes(spark, sf)))


def latest_event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive up to 99 hours late; the newest event wins, not the last arrival."""
    late = wide_writes(spark, sf).withColumn(
        EVENT_TS, F.timestamp_add("HOUR", -F.col("last_k"), F.col(EVENT_TS))
    )
    return lv.latest_view(ACTIVITY, late, order=lv.EVENT_TIME)


def latest_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return lv.latest_view(ACTIVITY, wide_writes(spark, sf), as_of=AS_OF)


def customer_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


def online_lookup(spark: SparkSession, sf: str) -> DataFrame:
    view = lv.latest_view(ACTIVITY, wide_writes(spark, sf), as_of=AS_OF)
    return lv.lookup_latest(ACTIVITY, customer_ids(spark, sf), view)


def partial_lookup(spark: SparkSession, sf: str) -> DataFrame:
    view = lv.latest_view(ACTIVITY, wide_writes(spark, sf), as_of=AS_OF)
    return lv.lookup_latest(ACTIVITY, customer_ids(spark, sf), view, ["click", "is_big", "nope"])


ORDERS_GROUP = FeatureGroup(
    "order_activity",
    "o_custkey",
    (
        Feature("last_price", F64, default_value=-1.0),
        Feature("last_status", TEXT, default_value="none"),
    ),
    ttl_seconds=0,
    entity_dtype=I64,
)


def model_features(spark: SparkSession, sf: str) -> DataFrame:
    order_writes = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_totalprice").alias("last_price"),
        F.col("o_orderstatus").alias("last_status"),
        F.col("o_orderdate").alias(EVENT_TS),
        F.col("o_orderdate").alias(WRITE_TS),
        F.col("o_orderkey").alias(SEQ),
    )
    views = {
        "activity": (ACTIVITY, lv.latest_view(ACTIVITY, wide_writes(spark, sf), as_of=AS_OF)),
        "order_activity": (ORDERS_GROUP, lv.latest_view(ORDERS_GROUP, order_writes)),
    }
    model = ModelVersion("churn", 1, ("activity", "order_activity", "not_registered"))
    return lv.features_for_model(model, customer_ids(spark, sf), views, "user_id")


def feature_age(spark: SparkSession, sf: str) -> DataFrame:
    found = online_lookup(spark, sf)
    return found.select(
        "user_id", EVENT_TS, F.round(age_seconds(F.col(EVENT_TS), AS_OF), 6).alias("age_seconds")
    )


def kv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exported fields, one row each; doubles are shown as numbers because their
    text form is not standardised."""
    view = lv.latest_view(ACTIVITY, wide_writes(spark, sf), as_of=AS_OF)
    return kv_fields(export_kv(ACTIVITY, view))


def kv_fields(exported: DataFrame) -> DataFrame:
    fields = exported.select("key", F.explode("fields").alias("field", "text"))
    is_number = F.col("field").isin([*TYPES, EVENT_TS])
    return fields.select(
        "key",
        "field",
        F.when(~is_number, F.col("text")).alias("text"),
        F.round(F.when(is_number, F.col("text")).cast("double"), 6).alias("number"),
    )


def kv_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The export as of the split, brought up to date by the changes since: fields as in
    ``kv_export``."""
    path = new_run_dir(spark, "kv")
    writes = wide_writes(spark, sf)
    early = F.col(WRITE_TS) < F.lit(SPLIT)
    state.add_writes(ACTIVITY, writes.filter(early), path, "early")
    first = state.compact(spark, ACTIVITY, path)
    state.add_writes(ACTIVITY, writes.filter(~early), path, "late")
    state.compact(spark, ACTIVITY, path)
    before = export_kv(ACTIVITY, state.generation_view(spark, ACTIVITY, path, first, SPLIT))
    changed = export_changes(ACTIVITY, state.changes(spark, ACTIVITY, path, first, None, SPLIT, AS_OF))
    return kv_fields(apply_changes(before, changed))


VECTORS = FeatureGroup(
    "vectors",
    "vec_id",
    (
        Feature("embedding", FeatureType.FLOAT_LIST),
        Feature("label", I64, default_value=-1),
        Feature("missing", TEXT, default_value="fallback"),
    ),
    entity_dtype=I64,
)


def kv_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias(EVENT_TS),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("bigint").alias("label"),
        F.lit(None).cast("string").alias("missing"),
    )
    decoded = decode(VECTORS, encode(VECTORS, rows))
    return decoded.select(
        "key",
        EVENT_TS,
        "label",
        "missing",
        F.posexplode("embedding").alias("pos", "x"),
    ).withColumn("x", F.round("x", 6))


# ---- transform and streaming -----------------------------------------------

MESSAGE = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("k", T.LongType()),
        T.StructField("ts", T.StringType()),
    ]
)
#: Times that some messages have instead: no number, out of range, no time at all.
ODD_TIMES = {44: "NaN", 46: "1e300", 48: "yesterday"}
STREAMED = FeatureGroup(
    "streamed",
    "user_id",
    (Feature("value", F64), Feature("k", I64), Feature("event_type", TEXT)),
    entity_dtype=I64,
)


def message_texts(rows: DataFrame) -> DataFrame:
    """Events as JSON messages (value, offset, at); those with k ending in 3 are cut off
    mid-text, and some have an event time that is none."""
    seconds = (ntz_to_micros(F.col("ts")) / F.lit(1e6)).cast("string")
    for k, text in ODD_TIMES.items():
        seconds = F.when(k_of() == k, text).otherwise(seconds)
    text = F.to_json(F.struct("user_id", "event_type", "value", k_of().alias("k"), seconds.alias("ts")))
    cut = F.when(k_of() % 10 == 3, F.substring(text, 1, 20)).otherwise(text)
    return rows.select(cut.alias("value"), F.col("event_id").alias("offset"), F.col("ts").alias("at"))


def to_messages(rows: DataFrame) -> DataFrame:
    return ms.parse_messages(message_texts(rows), MESSAGE, seq=F.col("offset"), write_ts=F.col("at"))


def even_k(msg: Column) -> tf.Record:
    return tf.Record(
        entity=msg["user_id"],
        values={"value": msg["value"], "k": msg["k"], "event_type": msg["event_type"]},
        event_ts=msg["ts"],
        keep=msg["k"] % 2 == 0,
    )


def transform_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    rows = tf.apply_transform(STREAMED, to_messages(events(spark, sf)), even_k)
    return rows.select(
        F.col(SEQ).alias("event_id"),
        F.col(tf.STATUS).alias("status"),
        "user_id",
        "k",
        F.round(ntz_to_micros(F.col(EVENT_TS)) / F.lit(1e6), 3).alias("seconds"),
        F.col(tf.REASON).alias("reason"),
        # Rejected messages are kept whole.
        F.when(F.col(tf.STATUS) == tf.ERROR, F.length(ms.RAW)).cast("bigint").alias("raw_length"),
        F.when(F.col(tf.STATUS) == tf.ERROR, F.sha2(F.col(ms.RAW), 256)).alias("raw_sha256"),
    )


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Three partitions, by event."""
    rows = tf.apply_transform(STREAMED, to_messages(events(spark, sf)), even_k)
    return tf.ingest_stats(rows.withColumn(ms.PARTITION, F.col(SEQ) % 3))


def _job(base: str, partitions: int | None = None) -> ingest.Ingest:
    return ingest.Ingest(
        STREAMED,
        even_k,
        root=f"{base}/offline",
        state_path=f"{base}/latest",
        stats_path=f"{base}/stats",
        dead_letter_path=f"{base}/dead",
        partitions=partitions,
    )


def _stream(spark: SparkSession, sf: str, label: str) -> ingest.Ingest:
    """Run the events table through the stream and wait for its end."""
    base = new_run_dir(spark, label)
    job = _job(base)
    source = (
        spark.readStream.schema(events(spark, sf).schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    query = ingest.start_ingest(
        to_messages(source), job, f"{base}/checkpoint", available_now=True
    )
    query.awaitTermination()
    return job


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    job = _stream(spark, sf, "stream-offline")
    return offline.read_features(spark, STREAMED, job.root).select(
        "user_id", EVENT_TS, "value", "k", "event_type"
    )


def _sixths(spark: SparkSession, sf: str, path: str) -> Iterator[int]:
    """Append the events to a folder in six parts by id, as many files as Spark makes of each.

    The cuts come from a mergeable sketch of all ids, so that no task holds every id; each row
    is in exactly one part wherever they lie.
    """
    rows = events(spark, sf)
    parts = rows.select(F.percentile_approx("event_id", [i / 6 for i in range(1, 6)])).first()[0]
    before = None
    for i, upto in enumerate([*parts, None]):
        here = F.lit(True) if before is None else F.col("event_id") > before
        here = here if upto is None else here & (F.col("event_id") <= upto)
        rows.filter(here).write.mode("append").parquet(path)
        before = upto
        yield i


def stream_latest_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Six micro-batches, with compaction after every second one; the last comes after it."""
    base = new_run_dir(spark, "stream-multi")
    job = _job(base)
    for i in _sixths(spark, sf, f"{base}/in"):
        source = spark.readStream.schema(events(spark, sf).schema).parquet(f"{base}/in")
        query = ingest.start_ingest(to_messages(source), job, f"{base}/checkpoint", available_now=True)
        query.awaitTermination()
        if i in (1, 3):
            state.compact(spark, STREAMED, job.state_path)
            state.vacuum(spark, job.state_path)
    return state.read_latest(spark, STREAMED, job.state_path)


def stateful_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest view kept in the stream's state, over six micro-batches of about five days;
    the ttl is two, so that records are wiped and expire between them."""
    base = new_run_dir(spark, "stateful")
    for i in _sixths(spark, sf, f"{base}/in"):
        source = spark.readStream.schema(events(spark, sf).schema).parquet(f"{base}/in")
        query = stateful.start_stateful(
            ACTIVITY, writes_of(source), f"{base}/out", f"{base}/checkpoint", available_now=True
        )
        query.awaitTermination()
        if i == 3:
            stateful.compact_changes(spark, ACTIVITY, f"{base}/out")
    return stateful.read_stateful(spark, ACTIVITY, f"{base}/out", as_of=AS_OF)


def _landed(spark: SparkSession, sf: str, path: str, partition: Column, file_rows: int) -> None:
    texts = message_texts(events(spark, sf)).withColumnRenamed("at", "timestamp")
    ms.land_messages(texts.withColumn("partition", partition.cast("int")), path, file_rows)


def bounded_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Messages landed week by week in files of at most an eighth of all rows, one file a
    micro-batch: how many batches took how many messages."""
    base = new_run_dir(spark, "bounded")
    eighth = events(spark, sf).count() // 8 + 1
    _landed(spark, sf, f"{base}/in", F.floor(F.dayofyear("timestamp") / 7), eighth)
    bounds = ms.Bounds(most_files=1)
    job = _job(base)
    messages = ms.read_landed(spark, f"{base}/in", MESSAGE, bounds=bounds)
    ingest.start_ingest(messages, job, f"{base}/checkpoint", available_now=True, bounds=bounds).awaitTermination()
    batches = ingest.batch_stats(spark, job).groupBy("batch_id").agg(F.sum("messages_consumed").alias("messages"))
    return batches.groupBy("messages").agg(F.count(F.lit(1)).alias("batches"))


def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The accounts of ``ingest_stats``, observed while two micro-batches are written."""
    base = new_run_dir(spark, "observed")
    _landed(spark, sf, f"{base}/in", F.col("offset") % 3, 1 << 40)
    bounds = ms.Bounds(most_files=2)
    job = _job(base, partitions=3)
    messages = ms.read_landed(spark, f"{base}/in", MESSAGE, bounds=bounds)
    with progress.ProgressLog(spark, f"{base}/progress") as log:
        query = ingest.start_ingest(messages, job, f"{base}/checkpoint", available_now=True, bounds=bounds)
        progress.await_batches(query, log)
    return ingest.read_stats(spark, job)


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    job = _stream(spark, sf, "stream-latest")
    state.compact(spark, STREAMED, job.state_path)
    return state.read_latest(spark, STREAMED, job.state_path)


# ---- drift -----------------------------------------------------------------


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_extendedprice"]
    edges = quantile_edges(table(spark, sf, "lineitem"), columns)
    return edges.withColumn("edge", F.round("edge", 6))


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf)
    return rows.filter(F.col("ts") < F.lit(SPLIT)), rows.filter(F.col("ts") >= F.lit(SPLIT))


def sketch_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from sketches of single months, and whether each is as near to its rank as stated."""
    columns = ["l_quantity", "l_discount", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    kept = sketches.sketch_values(rows, columns, ("month",))
    merged = sketches.merge_sketches(kept)
    asked = sketches.read_quantiles(merged, [i / 10 for i in range(11)])
    long = quantiles_module.long_form(rows, columns)
    return within_rank(sketches.rank_gaps(long, asked, "value", "value", ("feature",))).select("feature", "n", "pos", "near")


def within_rank(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("near", F.col("gap") <= sketches.SURE * sketches.rank_error())


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Latencies of each model from sketches of single days, and whether their ranks hold."""
    log = events(spark, sf).select(F.col("event_type").alias("model_name"), (F.col("value") / 500).alias("latency"), "ts")
    kept = sketches.sketch_days(log, ["latency"], "ts", ("model_name",))
    found = sketches.latency_quantiles(kept, (0.5, 0.9, 0.99))
    gaps = sketches.rank_gaps(log, found, "latency", "seconds", ("model_name",))
    return within_rank(gaps).select("model_name", "n", "probability", "near")


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    before, after = halves(spark, sf)
    found = drift.histogram(before, after, ["value"])
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


def rounded(report: DataFrame) -> DataFrame:
    return report.withColumn("statistic", F.round("statistic", 6))


def psi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drift.psi(*halves(spark, sf), ["value"]))


def psi_shifted(spark: SparkSession, sf: str) -> DataFrame:
    before, after = halves(spark, sf)
    return rounded(drift.psi(before, after.withColumn("value", F.col("value") * 3), ["value"]))


def psi_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    """A constant baseline, a current side out of range, and an empty current side."""
    before, after = halves(spark, sf)
    nothing = F.lit(None).cast("double")

    def case(rows: DataFrame, same: Column, far: Column, empty: Column) -> DataFrame:
        return rows.select(same.alias("same"), far.alias("far"), empty.alias("empty"))

    five = F.lit(5.0) + F.col("value") * 0
    base = case(before, five, five, F.col("value"))
    now = case(after, F.when(F.col("value") > 20, five).otherwise(F.col("value")), five + 1, nothing)
    return rounded(drift.psi(base, now, ["same", "far", "empty"]))


def psi_daily(spark: SparkSession, sf: str) -> DataFrame:
    """One baseline against every later day."""
    before, after = halves(spark, sf)
    daily = after.withColumn("day", F.to_date("ts"))
    return rounded(drift.psi(before, daily, ["value"], window="day"))


def psi_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """One baseline against every seven days, by one day; the first half of the later rows
    comes as histograms that were kept."""
    before, after = halves(spark, sf)
    edges = drift.fit_edges(before, ["value"])
    day = 86_400
    early, late = after.filter(F.dayofmonth("ts") < 23), after.filter(F.dayofmonth("ts") >= 23)
    kept = drift.pane_histograms(early, edges, "ts", day)
    found = drift.sliding_psi(before, late, ["value"], "ts", 7 * day, day, edges=edges, panes=kept)
    return rounded(found)


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return drift.category_counts(*halves(spark, sf), ["event_type"])


def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drift.chi_square(*halves(spark, sf), ["event_type"]))


def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    edge = F.lit("1998-01-01")
    before, after = rows.filter(F.col("l_shipdate") < edge), rows.filter(F.col("l_shipdate") >= edge)
    return rounded(
        drift.drift_report(before, after, ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    )


# ---- registry rules --------------------------------------------------------


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Every order registers a new version of its customer's group."""
    log = table(spark, sf, "orders").select(
        F.concat(F.lit("grp_"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("entity"),
        (F.col("o_orderkey") % 7 * 3600).alias("ttl_seconds"),
        F.array(
            F.struct(F.col("o_orderstatus").alias("name"), F.lit("int64").alias("dtype"))
        ).alias("features"),
    )
    return registry.list_groups(registry.latest_version(log))


def order_deployments(spark: SparkSession, sf: str) -> DataFrame:
    mode = (
        F.when(F.col("o_orderstatus") == "F", PRODUCTION)
        .when(F.col("o_orderstatus") == "O", CANARY)
        .otherwise(SHADOW)
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("m_"), F.col("o_custkey").cast("string")).alias("model_name"),
        (F.col("o_orderkey") % 50).cast("int").alias("model_version"),
        mode.alias("mode"),
        (F.col("o_orderkey") % 101).cast("int").alias("traffic_pct"),
        F.col("o_orderdate").alias("created_at"),
    )


def active_deployments(spark: SparkSession, sf: str) -> DataFrame:
    return registry.active_deployments(order_deployments(spark, sf))


def user_specs(rows: DataFrame) -> DataFrame:
    """One group per user; a feature per event type, typed by the largest value seen."""
    typed = rows.groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    dtype = F.when(F.col("top") < 60, "int64").otherwise("float64")
    feature = F.struct(F.col("event_type").alias("name"), dtype.alias("dtype"))
    return typed.groupBy(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name")
    ).agg(F.collect_list(feature).alias("features"))


def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    before, after = halves(spark, sf)
    return registry.schema_diff(user_specs(before), user_specs(after))


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Models per nation need the segments of their customers; one segment is not
    registered."""
    customers = table(spark, sf, "customer")
    models = customers.groupBy(
        F.concat(F.lit("model_"), F.col("c_nationkey").cast("string")).alias("name")
    ).agg(
        F.max("c_custkey").alias("version"),
        F.collect_set("c_mktsegment").alias("feature_groups"),
    )
    named = F.struct(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("name"),
        F.lit("int64").alias("dtype"),
    )
    balance = F.struct(F.lit("acctbal").alias("name"), F.lit("float64").alias("dtype"))
    specs = customers.filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_mktsegment").alias("name"),
        F.col("c_custkey").alias("version"),
        F.array(balance, named).alias("features"),
    )
    return registry.lineage(models, specs)


# ---- routing and scoring ---------------------------------------------------


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a request to the model named after its type."""
    return events(spark, sf).select(
        "event_id",
        F.col("event_type").alias("model_name"),
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("ts").alias("request_ts"),
    )


def daily_deployments(spark: SparkSession, sf: str, versions: int | None = None) -> DataFrame:
    """One deployment per model and day at the day's first event, the mode by the day.

    ``signup`` is never deployed and ``view`` only as a shadow.
    """
    day = F.dayofmonth("ts")
    daily = (
        events(spark, sf)
        .filter(F.col("event_type") != "signup")
        .groupBy(F.col("event_type").alias("model_name"), day.alias("day"))
        .agg(F.min("event_id").alias("id"), F.min("ts").alias("created_at"))
    )
    mode = (
        F.when(F.col("model_name") == "view", SHADOW)
        .when(F.col("day") % 4 == 1, CANARY)
        .when(F.col("day") % 4 == 2, SHADOW)
        .otherwise(PRODUCTION)
    )
    version = F.col("day") if versions is None else F.col("day") % versions + 1
    return daily.select(
        "id",
        "model_name",
        version.cast("int").alias("model_version"),
        mode.alias("mode"),
        (F.col("day") * 7 % 100).cast("int").alias("traffic_pct"),
        "created_at",
    )


def bucket(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select(
        "event_id", canary_bucket(F.col("model_name"), F.col("entity_id")).alias("bucket")
    )


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route_requests(requests(spark, sf), daily_deployments(spark, sf))


def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    return route_columns(routed(spark, sf))


def route_columns(found: DataFrame) -> DataFrame:
    shadows = F.array_join(F.transform("shadow_versions", lambda v: v.cast("string")), ",")
    return found.select(
        "event_id", "bucket", "model_version", "mode", shadows.alias("shadows"), "route_error"
    )


def route_large_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same routes by sweeping the log, as if it were too large for arrays, in chunks of
    three deployments and a thousand requests."""
    bucket_ = canary_bucket(F.col("model_name"), F.col("entity_id"))
    found = sweep.route_sweep(requests(spark, sf), daily_deployments(spark, sf), bucket_, starts=3, request_rows=1000)
    return route_columns(found)


def cohort_split(spark: SparkSession, sf: str) -> DataFrame:
    served = routed(spark, sf).filter(F.col("model_version").isNotNull())
    split = servelog.cohort_split(served)
    return split.withColumns({c: F.round(c, 6) for c in ("request_share", "entity_share")})


def predict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return servelog.predict_counts(routed(spark, sf).filter(F.col("mode").isNotNull()))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    log = events(spark, sf).select(
        F.col("event_type").alias("model_name"), (F.col("value") / 500).alias("latency")
    )
    found = servelog.latency_histogram(log, "latency")
    return found.withColumns(
        {
            "le": F.when(F.col("le") < float("inf"), F.col("le")),
            "total_seconds": F.round("total_seconds", 6),
        }
    )


def fetch_histogram(spark: SparkSession, sf: str) -> DataFrame:
    log = events(spark, sf).select(
        F.col("event_type").alias("model_name"), (F.col("value") / 2000).alias("latency")
    )
    found = servelog.latency_histogram(log, "latency", servelog.FEATURE_FETCH_BUCKETS)
    return found.withColumns(
        {
            "le": F.when(F.col("le") < float("inf"), F.col("le")),
            "total_seconds": F.round("total_seconds", 6),
        }
    )


SERVED = FeatureGroup(
    "served",
    "entity_id",
    (
        Feature("click", F64, default_value=0.0),
        Feature("error", F64, default_value=0.0),
        Feature("view", F64),
    ),
    ttl_seconds=0,
)
ORDER = ["click", "error", "view"]


def _steps(weights: list[float], limit: float, fails: bool = False) -> scoring.Predictor:
    linear = scoring.linear_predictor(weights, 1.0)

    def predict(vector: Column) -> Column:
        hit = F.when(linear(vector) > limit, 1.0).otherwise(0.0)
        # A failing model yields no value.
        answer = F.when(vector[0] > 20, hit) if fails else hit
        return F.when(vector.isNotNull(), answer)

    return predict


def _predictors() -> dict[tuple[str, int], scoring.Predictor]:
    """Versions 1 and 4 are production, 2 canary, 3 shadow; ``error`` has none loaded."""
    models = {}
    for model in ("click", "purchase"):
        models[model, 1] = _steps([1.0, 0.5, 0.25], 40.0)
        models[model, 2] = _steps([0.5, 1.0, 0.25], 40.0)
        models[model, 3] = _steps([0.25, 0.5, 1.0], 40.0, fails=True)
        models[model, 4] = scoring.linear_predictor([0.1, 0.2, 0.3], -1.0)
    return models


def scored(spark: SparkSession, sf: str) -> DataFrame:
    writes = wide_writes(spark, sf).withColumn(
        "entity_id", F.concat(F.lit("u_"), F.col("user_id").cast("string"))
    )
    views = {"served": (SERVED, lv.latest_view(SERVED, writes))}
    model = ModelVersion("any", 1, ("served",))
    log = daily_deployments(spark, sf, versions=4)
    return serve(requests(spark, sf), log, model, views, _predictors(), ORDER)


def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "event_id",
        "model_version",
        F.round("prediction", 6).alias("prediction"),
        F.round(F.col("shadow_predictions")["v3"], 6).alias("shadow_v3"),
        "score_error",
    )


def shadow_agreement(spark: SparkSession, sf: str) -> DataFrame:
    served = scored(spark, sf).filter(F.col("prediction").isNotNull())
    found = servelog.shadow_agreement(served)
    return found.withColumns({c: F.round(c, 6) for c in ("agreement", "mean_abs_diff")})


#: Weights of click and view, and the intercept, of the stored versions of one model.
STORED = {1: (2.0, 0.5, 1.0), 2: (0.25, 1.0, -1.0), 3: (1.0, -1.0, 0.5)}


def pipeline_score(spark: SparkSession, sf: str) -> DataFrame:
    """Requests scored by stored pipelines, each fitted on all users' features to a linear
    target; what was measured comes from the store."""
    root = new_run_dir(spark, "models")
    writes = wide_writes(spark, sf).withColumn("entity_id", F.concat(F.lit("u_"), F.col("user_id").cast("string")))
    # Fits, measures and requests read the view, which is folded from all writes once.
    kept = f"{new_run_dir(spark, 'model-view')}/view"
    latest = lv.latest_view(SERVED, writes)
    latest.write.parquet(kept)
    view = spark.read.schema(latest.schema).parquet(kept)
    order = ["click", "view"]
    for version, (a, b, c) in STORED.items():
        target = F.lit(a) * F.coalesce("click", F.lit(0.0)) + F.lit(b) * F.coalesce("view", F.lit(0.0)) + F.lit(c)
        training = view.withColumn("label", target)
        model = modelstore.fit_pipeline(training, "label", order, [LinearRegression(solver="normal")])
        fit = modelstore.measure(model, training, "label", order, RegressionEvaluator(metricName="r2"))
        modelstore.save_model(spark, root, "click", version, model, order, {"r2": fit})
    stored = {("click", v): modelstore.load_model(spark, root, "click", v) for v in STORED}
    spec = ModelVersion("click", 1, ("served",))
    wanted = lv.features_for_model(spec, requests(spark, sf), {"served": (SERVED, view)}, "entity_id")
    attached = lv.attach_features(requests(spark, sf), wanted, "entity_id")
    found = routing.route_requests(attached, daily_deployments(spark, sf, versions=4))
    scored_ = modelstore.score_pipelines(found, stored, "event_id")
    measured = modelstore.list_models(spark, root).select(
        F.col("version").alias("model_version"), F.col("name").alias("model_name"), F.round(F.col("metrics")["r2"], 6).alias("r2")
    )
    return scored_.join(F.broadcast(measured), ["model_name", "model_version"], "left").select(
        "event_id",
        "model_version",
        F.round("prediction", 4).alias("prediction"),
        F.round(F.col("shadow_predictions")["v3"], 4).alias("shadow_v3"),
        "score_error",
        "r2",
    )


def _own_groups(spark: SparkSession, sf: str) -> dict[str, tuple[FeatureGroup, DataFrame]]:
    groups = {}
    for name in ("click", "view"):
        fg = FeatureGroup(name, "entity_id", (Feature("value", F64, default_value=0.0),))
        rows = events(spark, sf).filter(F.col("event_type") == name)
        entity = F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("entity_id")
        groups[name] = (fg, rows.select(entity, F.col("ts").alias(EVENT_TS), "value"))
    return groups


def _served_at_request(spark: SparkSession, sf: str) -> DataFrame:
    """Version 1 uses clicks, version 2 clicks and views, others are not in the model log."""
    models, predictors = [], {}
    for name in ("click", "purchase"):
        models += [ModelVersion(name, 1, ("click",)), ModelVersion(name, 2, ("click", "view"))]
        predictors[name, 1] = scoring.linear_predictor([2.0], 1.0)
        predictors[name, 2] = scoring.linear_predictor([0.5, 0.25], -1.0)
    log = daily_deployments(spark, sf, versions=4)
    return serve_at_request(requests(spark, sf), log, models, _own_groups(spark, sf), predictors)


def request_score(spark: SparkSession, sf: str) -> DataFrame:
    return _served_at_request(spark, sf).select(
        "event_id", "model_version", F.round("prediction", 6).alias("prediction"), "score_error"
    )


def request_age(spark: SparkSession, sf: str) -> DataFrame:
    ages = F.col("feature_age_seconds")
    return _served_at_request(spark, sf).select(
        "event_id", *[F.round(ages[n], 6).alias(f"{n}_age") for n in ("click", "view")]
    )


def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    view = lv.latest_view(ACTIVITY, wide_writes(spark, sf), as_of=AS_OF)
    order = ["click", "last_k", "is_big", "purchase"]
    vectors = customer_ids(spark, sf).join(view, "user_id", "left").withColumn(
        "vector", scoring.feature_vector(order)
    )
    return vectors.select("user_id", *[F.col("vector")[i].alias(f"x{i}") for i in range(4)])


# ---- feeders and training --------------------------------------------------


def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    found = rolling.rolling_features(
        events(spark, sf),
        "user_id",
        "ts",
        is_login=kind == "view",
        session_seconds=F.when(kind == "click", F.col("value")),
        used_feature=kind,
        days=7,
    )
    return found.withColumn("avg_session_seconds", F.round("avg_session_seconds", 6))


def synth(spark: SparkSession, sf: str) -> DataFrame:
    entities = table(spark, sf, "customer")
    found = synth_features(entities, "c_custkey", AS_OF)
    return found.withColumn("minutes", F.round("minutes", 4))


def train_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on a point-in-time training set; label: a purchase above 20. Reports the
    set's size and balance, and whether the trees are at least as often right as the more
    frequent label."""
    spine = events(spark, sf).filter(F.col("event_type") == "purchase")
    spine = spine.select(
        "user_id", F.col("ts").alias("event_ts"), (F.col("value") > 20).cast("int").alias("label")
    )
    names = ("click", "view")
    groups = [(event_group(n), event_features(spark, sf, n)) for n in names]
    training = point_in_time_join(spine, groups, "user_id").persist(StorageLevel.MEMORY_AND_DISK)
    order = [f"{n}_value" for n in names]
    model = scoring.train_gbt(training, "label", order)
    reached = scoring.accuracy(model, training, "label", order)
    rows, positives = training.agg(F.count(F.lit(1)), F.sum("label")).first()
    training.unpersist()
    majority = max(positives, rows - positives) / rows
    found = [(rows, positives, model.getNumTrees, reached >= majority)]
    return spark.createDataFrame(found, "rows long, positives long, trees int, beats_majority boolean")


QUERIES = {
    "pit_join": pit_join,
    "pit_join_multi": pit_join_multi,
    "pit_join_ties": pit_join_ties,
    "pit_join_skew": pit_join_skew,
    "pit_join_keys": pit_join_keys,
    "training_from_store": training_from_store,
    "offline_roundtrip": offline_roundtrip,
    "evolved_scan": evolved_scan,
    "compacted_scan": compacted_scan,
    "dedup_features": dedup_features,
    "replay_fewer_dates": replay_fewer_dates,
    "evolution_checked": evolution_checked,
    "missing_columns": missing_columns,
    "latest_view": latest_view,
    "latest_event_time": latest_event_time,
    "latest_ttl": latest_ttl,
    "online_lookup": online_lookup,
    "partial_lookup": partial_lookup,
    "model_features": model_features,
    "feature_age": feature_age,
    "kv_export": kv_export,
    "kv_changes": kv_changes,
    "kv_decode": kv_decode,
    "transform_dead_letter": transform_dead_letter,
    "ingest_stats": ingest_stats,
    "stream_ingest": stream_ingest,
    "stream_latest": stream_latest,
    "stream_latest_multi": stream_latest_multi,
    "stateful_latest": stateful_latest,
    "bounded_batches": bounded_batches,
    "stream_stats": stream_stats,
    "quantile_edges": quantiles,
    "sketch_edges": sketch_edges,
    "histogram": histogram,
    "psi": psi,
    "psi_shifted": psi_shifted,
    "psi_degenerate": psi_degenerate,
    "psi_daily": psi_daily,
    "psi_sliding": psi_sliding,
    "category_counts": category_counts,
    "chi_square": chi_square,
    "drift_report": drift_report,
    "latest_version": latest_version,
    "active_deployments": active_deployments,
    "schema_diff": schema_diff,
    "lineage": lineage,
    "canary_bucket": bucket,
    "route_requests": route_requests,
    "route_large_log": route_large_log,
    "cohort_split": cohort_split,
    "predict_counts": predict_counts,
    "latency_histogram": latency_histogram,
    "latency_quantiles": latency_quantiles,
    "fetch_histogram": fetch_histogram,
    "batch_score": batch_score,
    "pipeline_score": pipeline_score,
    "shadow_agreement": shadow_agreement,
    "request_score": request_score,
    "request_age": request_age,
    "feature_vector": feature_vector,
    "rolling_features": rolling_features,
    "synth_features": synth,
    "train_eval": train_eval,
}
