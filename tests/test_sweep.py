import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import canary_bucket
from tidemark.operators import routing, sweep

T0 = datetime(2023, 5, 5)
LOG = "id long, model_name string, model_version int, mode string, traffic_pct int, created_at timestamp_ntz, retired_at timestamp_ntz"


def at(n):
    return T0 + timedelta(minutes=n)


def log_rows(seed, n):
    draw = random.Random(seed)
    rows = []
    for i in draw.sample(range(1000), n):
        since = draw.choice([None, *range(0, 300, 5)]) if draw.random() < 0.05 else draw.randrange(0, 300, 5)
        mode = draw.choice(["production", "canary", "canary", "shadow"])
        ends = None if since is None or draw.random() < 0.6 else at(since + draw.randrange(0, 100, 5))
        rows.append((i, draw.choice(["big", "big", "mid", "rare"]), draw.randint(1, 9), mode, draw.choice([None, 0, 5, 30, 60, 100, 120]), None if since is None else at(since), ends))
    return rows


def request_rows(seed, n):
    draw = random.Random(seed)
    models = ["big"] * 4 + ["mid", "rare", "none", None]
    rows = [(i, draw.choice(models), draw.choice([None, *(f"e{j}" for j in range(60))]), draw.choice([None] + [at(draw.randrange(-10, 330)) for _ in range(30)])) for i in range(n)]
    return rows + rows[:5]


def frames(spark, seed, deployments=60, requests=400):
    log = spark.createDataFrame(log_rows(seed, deployments), LOG)
    asked = spark.createDataFrame(request_rows(seed, requests), "event_id long, model_name string, entity_id string, request_ts timestamp_ntz")
    return asked, log


def answers(df):
    names = ("event_id", "model_name", "entity_id", "request_ts", "bucket", "model_version", "mode", "route_error")
    return Counter((*(r[c] for c in names), tuple(r.shadow_versions)) for r in df.collect())


@pytest.mark.parametrize(("starts", "rows"), [(1, 3), (4, 20), (2000, 500_000)])
def test_sweep_equals_arrays(spark, starts, rows):
    asked, log = frames(spark, starts)
    bucket = canary_bucket(F.col("model_name"), F.col("entity_id"))
    found = sweep.route_sweep(asked, log, bucket, starts=starts, request_rows=rows)
    wanted = routing.route_requests(asked, log)
    assert set(found.columns) == set(wanted.columns)
    # Arrays give a request without a model no bucket either.
    assert answers(found.fillna(-1, ["bucket"])) == answers(wanted.fillna(-1, ["bucket"]))


def test_logs_beyond_the_bound_are_swept(spark):
    asked, log = frames(spark, 9)
    plan = routing.route_requests(asked, log, small_log=10)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan
    assert "collect_list" in routing.route_requests(asked, log)._jdf.queryExecution().executedPlan().toString()
    assert answers(routing.route_requests(asked, log, small_log=10).fillna(-1, ["bucket"])) == answers(routing.route_requests(asked, log).fillna(-1, ["bucket"]))


def test_empty_sides(spark):
    asked, log = frames(spark, 3, requests=20)
    nothing = sweep.route_sweep(asked, log.limit(0), F.lit(1))
    assert {r.route_error for r in nothing.collect()} == {sweep.NO_DEPLOYMENT}
    assert sweep.route_sweep(asked.limit(0), log, F.lit(1)).count() == 0


def test_what_never_ends_and_decides_nothing_is_not_carried(spark):
    rows = [(i, "m", 1 + i % 3, "shadow", None, at(i), None) for i in range(200)]
    rows += [(1000 + i, "m", i, "canary", 10 * (i % 4), at(i), None) for i in range(200)]
    log = sweep.deployment_intervals(spark.createDataFrame(rows, LOG)).select(
        F.col("model_name").alias("model"), "id", F.col("model_version").alias("version"), "mode", F.col("traffic_pct").alias("pct"),
        F.col("id").alias("since"), F.lit(int(sweep._FOREVER)).alias("until"),
    )
    assert sweep._carried(log).filter("lasts").groupBy("mode").count().orderBy("mode").collect() == [("canary", 4), ("shadow", 3)]


def test_borders_cut_the_starts_of_each_model(spark):
    starts = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", 5)] * 30 + [("c", 1)], "model string, since long")
    borders = sweep._borders(starts, 50)
    assert 19 <= len(borders["a"]) <= 30 and np.all(np.diff(borders["a"]) > 0)
    assert max(np.diff(np.r_[0, borders["a"], 1000])) <= 50
