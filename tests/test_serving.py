import hashlib
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureGroup, ModelVersion
from tidemark.functions.hashing import canary_bucket
from tidemark.operators import registry, routing, scoring, servelog, skew
from tidemark.plans.serving import serve

T0 = datetime(2024, 1, 1)
LOG = "id long, model_name string, model_version int, mode string, traffic_pct int, created_at timestamp"


def valve(version, **dtypes):
    return FeatureGroup("valve", "valve_no", tuple(Feature(n, t) for n, t in dtypes.items()), version, ttl_seconds=60 * version)


def test_spec_log_answers_by_version_and_newest(spark):
    """Versions registered in no order; what is newest is decided by number, not by time."""
    versions = [11, 2, 40, 7]
    made = {v: valve(v, **{f"f{i}": "float64" for i in range(v % 5 + 1)}) for v in versions}
    log = registry.spec_log(spark, [made[v] for v in versions])
    assert registry.get_version(log, "valve").first().version == 40
    for v in versions:
        row = registry.get_version(log, "valve", v).first()
        assert [f.name for f in row.features] == made[v].feature_names
    assert registry.get_version(log, "valve", 3).count() == registry.get_version(log, "pump").count() == 0
    listed = {(r.version, r.n_features, r.ttl_seconds) for r in registry.list_groups(log).collect()}
    assert listed == {(v, v % 5 + 1, 60 * v) for v in versions}


OLD = {"flow": "float64", "seal": "string", "turns": "int64"}


@pytest.mark.parametrize(
    ("new", "removed", "retyped", "added"),
    [
        ({**OLD, "leaks": "bool"}, [], [], ["leaks"]),
        (dict(reversed(OLD.items())), [], [], []),
        ({"flow": "float64", "turns": "int64"}, ["seal"], [], []),
        ({**OLD, "turns": "float64"}, [], ["turns"], []),
        ({"seal": "bool", "spring": "int64"}, ["flow", "turns"], ["seal"], ["spring"]),
    ],
)
def test_what_a_version_may_change(spark, new, removed, retyped, added):
    before, after = valve(3, **OLD), valve(3, **new)
    if removed or retyped:
        with pytest.raises(ValueError, match=f"removed {re.escape(str(removed))}, retyped {re.escape(str(retyped))}"):
            registry.check_compatible(before, after)
    else:
        registry.check_compatible(before, after)
    log = [registry.spec_log(spark, [g]) for g in (before, after)]
    found = {(r.feature, r.change) for r in registry.schema_diff(*log).collect()}
    assert found == {(n, "removed") for n in removed} | {(n, "retyped") for n in retyped} | {(n, "added") for n in added}


def deployments(spark, rows):
    log = [(i, "churn", v, mode, pct, T0 + timedelta(hours=h)) for i, v, mode, pct, h in rows]
    df = spark.createDataFrame(log, LOG)
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@pytest.mark.parametrize("seed", [3, 4])
def test_active_deployments_of_random_logs(spark, seed):
    """Of the productions the one with the largest id, if it is not retired; of the others all
    that are not."""
    draw = random.Random(seed)
    rows = [(i, draw.randint(1, 99), draw.choice(["production", "canary", "shadow"]), draw.randint(0, 100), draw.randint(0, 50)) for i in draw.sample(range(500), 40)]
    retired = {r[0] for r in rows if draw.random() < 0.3}
    log = deployments(spark, rows)
    ends = F.when(F.col("id").isin(list(retired)), F.lit(T0).cast("timestamp_ntz"))
    last = max(r[0] for r in rows if r[2] == "production")
    kept = [r for r in rows if r[2] != "production" or r[0] == last]
    for table, gone in ((log, set()), (log.withColumn("retired_at", ends), retired)):
        found = {(r.id, r.model_version, r.mode, r.traffic_pct) for r in registry.active_deployments(table).collect()}
        assert found == {r[:4] for r in kept if r[0] not in gone}


def bucket(model, entity):
    return int(hashlib.sha256(f"{model}:{entity}".encode()).hexdigest(), 16) % 100


def test_bucket_equals_big_integer(spark):
    ids = [f"u_{i}" for i in range(2_000)] + ["", "ünï", "a b"]
    df = spark.createDataFrame([(i,) for i in ids], "e string")
    rows = df.select("e", canary_bucket(F.lit("churn"), F.col("e")).alias("b")).collect()
    assert all(r.b == bucket("churn", r.e) for r in rows)
    none = df.limit(1).select(canary_bucket(F.lit("m"), F.lit(None).cast("string")).alias("b"))
    assert none.first().b is None


def pick(entity, active):
    """(version, mode) by the documented precedence."""
    canaries = [d for d in active if d[2] == "canary"]
    for d in canaries:
        if bucket("churn", entity) < d[3]:
            return d[1], "canary"
    production = [d for d in active if d[2] == "production"]
    chosen = production or canaries
    return (chosen[0][1], chosen[0][2]) if chosen else (None, None)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 1, "production", 100, 0), (2, 2, "canary", 30, 0), (3, 3, "canary", 60, 0)],
        [(1, 1, "production", 100, 0), (2, 2, "canary", 0, 0)],
        [(1, 1, "production", 100, 0), (2, 2, "canary", 100, 0)],
        [(1, 4, "canary", 5, 0), (2, 5, "shadow", 100, 0), (3, 5, "shadow", 100, 0)],
        [(1, 7, "shadow", 100, 0)],
        [],
    ],
)
def test_routing_precedence(spark, rows):
    entities = [f"u_{i}" for i in range(200)]
    requests = spark.createDataFrame([("churn", e) for e in entities], "model_name string, entity_id string")
    routed = routing.route_requests(requests, deployments(spark, rows), request_ts=None)
    error = routing.NOT_SERVABLE if rows else routing.NO_DEPLOYMENT
    for r in routed.collect():
        want = pick(r.entity_id, rows)
        assert (r.model_version, r.mode) == want
        assert r.route_error == (None if want[0] else error)
        assert r.shadow_versions == sorted({d[1] for d in rows if d[2] == "shadow"})


def test_routing_by_request_time(spark):
    log = deployments(
        spark,
        [(1, 1, "production", 100, 1), (2, 2, "production", 100, 3), (3, 9, "shadow", 100, 2)],
    )
    requests = spark.createDataFrame(
        [(h, "churn", "u", T0 + timedelta(hours=h)) for h in range(5)],
        "h int, model_name string, entity_id string, request_ts timestamp",
    ).withColumn("request_ts", F.col("request_ts").cast("timestamp_ntz"))
    found = {r.h: (r.model_version, r.shadow_versions) for r in routing.route_requests(requests, log).collect()}
    assert found == {0: (None, []), 1: (1, []), 2: (1, [9]), 3: (2, [9]), 4: (2, [9])}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, "churn", 1, [2, 3, 8], 1.0, 2.0),
        (2, "churn", 2, [3], None, 4.0),
        (3, "churn", 7, [], 0.0, 0.0),
        (4, "churn", None, [], 0.0, 0.0),
    ]
    routed = spark.createDataFrame(
        rows, "r int, model_name string, model_version int, shadow_versions array<int>, a double, b double"
    )
    predictors = {
        ("churn", 1): scoring.linear_predictor([1.0, 10.0]),
        ("churn", 2): scoring.array_predictor(lambda m: m @ np.array([1.0, 10.0])),
        ("churn", 3): lambda v: F.when(v[0] > 0, v[0] * 2),
    }
    return scoring.score(routed, predictors, ["a", "b"])


def test_scoring(scored):
    rows = {r.r: r for r in scored.collect()}
    assert [rows[i].prediction for i in (1, 2, 3, 4)] == [21.0, 40.0, None, None]
    assert rows[1].shadow_predictions == {"v2": 21.0, "v3": 2.0}  # v8 is not loaded
    assert rows[2].shadow_predictions == {}  # v3 failed
    assert [rows[i].score_error for i in (1, 2, 3, 4)] == [None, None, scoring.NOT_LOADED, None]


def test_orders_and_overrides(spark):
    df = spark.createDataFrame(
        [("m", 1, [], 1.0, 2.0, {"b": 5.0})],
        "model_name string, model_version int, shadow_versions array<int>, a double, b double, o map<string,double>",
    )
    got = scoring.score(df, {("m", 1): scoring.linear_predictor([1.0, 10.0])}, {("m", 1): ["b", "a"]}, overrides="o")
    assert got.first().prediction == 15.0


def test_shadow_agreement(scored):
    rows = {r.shadow_version: r for r in servelog.shadow_agreement(scored).collect()}
    assert (rows[2].requests, rows[2].failures, rows[2].agreement) == (1, 0, 1.0)
    assert (rows[3].requests, rows[3].failures, rows[3].mean_abs_diff) == (2, 1, 19.0)
    assert (rows[8].failures, rows[8].agreement) == (1, None)


def test_latency_histogram(spark):
    values = [0.001, 0.005, 0.0051, 0.7, 3.0, None]
    df = spark.createDataFrame([("m", v) for v in values], "model_name string, latency double")
    rows = servelog.latency_histogram(df, "latency").collect()
    assert [r["count"] for r in sorted(rows, key=lambda r: r.le)] == [2, 3, 3, 3, 3, 3, 3, 4, 5]
    assert {r.total_count for r in rows} == {5}
    few = servelog.latency_histogram(df, "latency", servelog.FEATURE_FETCH_BUCKETS)
    assert few.count() == len(servelog.FEATURE_FETCH_BUCKETS) + 1
    assert servelog.latency_quantiles(df, "latency").first().latency_quantiles[0] == 0.0051


def test_cohorts_and_counts(spark):
    rows = [("m", 1, "a", "production")] * 3 + [("m", 2, "b", "canary")]
    log = spark.createDataFrame(rows, "model_name string, model_version int, entity_id string, mode string")
    split = {r.model_version: (r.entities, r.requests, r.request_share) for r in servelog.cohort_split(log).collect()}
    assert split == {1: (1, 3, 0.75), 2: (1, 1, 0.25)}
    counts = {r.mode: r.predictions for r in servelog.predict_counts(log).collect()}
    assert counts == {"production": 3, "canary": 1}


def test_skewed_lookups_keep_every_row(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot", "hot", f"k{i % 7}", None]), i % 3) for i in range(300)]
    left = spark.createDataFrame(rows, "k string, x int")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "k string, v int")
    value = {"hot": 1, "k1": 2}
    want = sorted(((k, x, value.get(k)) for k, x in rows), key=str)
    for found in (
        skew.lookup_join(left, table, "k", hot_rows=50),
        skew.lookup_join(left, table, "k"),
        skew.side_table_join(left, table, "k"),
        skew.side_table_join(left, table, "k", max_rows=2),
    ):
        assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_reduction_is_size_checked(spark):
    table = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.range(95, 105).withColumnRenamed("id", "k")
    assert skew.reduce_to(table, keys, "k").count() == 5
    assert skew.reduce_to(table, keys, "k", max_rows=9).count() == 100


def test_lineage_keeps_unregistered_groups(spark):
    models = spark.createDataFrame(
        [("press", 6, ["valve", "gone"])], "name string, version long, feature_groups array<string>"
    )
    specs = registry.spec_log(spark, [valve(9, **OLD), valve(5, x="int64")])
    rows = {tuple(r)[2:] for r in registry.lineage(models, specs).collect()}
    assert rows == {("gone", None, None), *(("valve", 9, n) for n in OLD)}


@pytest.mark.parametrize("hot_rows", [3, 100])
def test_serve_end_to_end(spark, hot_rows):
    log = deployments(
        spark, [(1, 1, "production", 100, 0), (2, 2, "canary", 50, 0), (3, 1, "shadow", 0, 0)]
    )
    fg = FeatureGroup("act", "uid", (Feature("a", "float64", default_value=1.0),))
    view = spark.createDataFrame([("u_0", 5.0, T0)], "uid string, a double, _event_ts timestamp_ntz")
    entities = ["u_0"] * 5 + [f"u_{i}" for i in range(20)]
    requests = spark.createDataFrame(
        [(i, "churn", e, T0 + timedelta(hours=1), {"a": 9.0} if i == 24 else {}) for i, e in enumerate(entities)],
        "r int, model_name string, entity_id string, request_ts timestamp_ntz, o map<string,double>",
    )
    served = serve(
        requests,
        log,
        ModelVersion("churn", 1, ("act", "unknown")),
        {"act": (fg, view)},
        {("churn", 1): scoring.linear_predictor([1.0]), ("churn", 2): scoring.linear_predictor([2.0])},
        ["a"],
        overrides="o",
        hot_rows=hot_rows,
    )
    rows = served.collect()
    assert len(rows) == 25
    for r in rows:
        version = 2 if bucket("churn", r.entity_id) < 50 else 1
        a = 9.0 if r.r == 24 else 5.0 if r.entity_id == "u_0" else 1.0
        assert (r.model_version, r.prediction) == (version, a * version)
        assert r.shadow_predictions == {"v1": a}
        assert r.feature_age_seconds == ({"act": 3600.0} if r.entity_id == "u_0" else {})


def test_models_that_raise(spark):
    def picky(matrix):
        if (matrix[:, 0] > 2).any():
            raise RuntimeError("cannot score")
        return matrix[:, 0] * 10

    rows = [(i, "m", 1 + i % 2, [2] if i % 2 == 0 else [], float(i)) for i in range(6)]
    routed = spark.createDataFrame(
        rows, "r int, model_name string, model_version int, shadow_versions array<int>, a double"
    ).coalesce(1)
    predictors = {("m", 1): scoring.array_predictor(lambda m: m[:, 0]), ("m", 2): scoring.array_predictor(picky)}
    found = {r.r: r for r in scoring.score(routed, predictors, ["a"]).collect()}
    assert [found[i].prediction for i in range(6)] == [0.0, 10.0, 2.0, None, 4.0, None]
    assert [found[i].score_error for i in (1, 3, 5)] == [None, scoring.FAILED, scoring.FAILED]
    assert [found[i].shadow_predictions for i in (0, 2, 4)] == [{"v2": 0.0}, {"v2": 20.0}, {}]
