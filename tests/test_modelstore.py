import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.operators import modelstore as store
from tidemark.plans import catalog
from tidemark.operators import sketches
from tidemark.operators.scoring import FAILED, NOT_LOADED, linear_predictor, score

KIND = "rid long, model_name string, model_version int, shadow_versions array<int>, a double, b double"
LINES = {1: ([2.0, -1.0], 0.5), 2: ([0.25, 1.0], -3.0), 5: ([1.0, 1.0], 0.0)}


def training(spark):
    draw = random.Random(3)
    return spark.createDataFrame([(draw.uniform(-2, 2), draw.uniform(-2, 2)) for _ in range(60)], "a double, b double")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    rows = training(spark)
    for version, (w, c) in LINES.items():
        labelled = rows.withColumn("label", w[0] * F.col("a") + w[1] * F.col("b") + c)
        model = store.fit_pipeline(labelled, "label", ["a", "b"], [LinearRegression(solver="normal")])
        rmse = store.measure(model, labelled, "label", ["a", "b"], RegressionEvaluator(metricName="rmse"))
        store.save_model(spark, root, "line", version, model, ["a", "b"], {"rmse": rmse, "rank": float(version % 5)})
    return root


def test_cards_hold_what_was_measured(spark, root):
    found = {r.version: r for r in store.list_models(spark, root).collect()}
    assert set(found) == set(LINES) and all(r.metrics["rmse"] < 1e-6 and r.order == ["a", "b"] for r in found.values())
    assert store.best_version(spark, root, "line", "rank") == 2
    assert store.best_version(spark, root, "line", "rank", larger=False) == 5
    assert store.best_version(spark, root, "line", "none") is None and store.best_version(spark, root, "other", "rank") is None
    with pytest.raises(ValueError, match="exists"):
        store.save_model(spark, root, "line", 1, store.load_model(spark, root, "line", 1).model, ["a", "b"], {})


def test_stored_pipelines_score_like_expressions(spark, root):
    draw = random.Random(8)
    rows = [(i, draw.choice(["line", "line", "other"]), draw.choice([None, 1, 2, 3]), draw.choice([[], [5], [2, 5, 9]]), draw.choice([None, draw.random()]), draw.random()) for i in range(80)]
    routed = spark.createDataFrame(rows, KIND).repartition(3)
    models = {("line", v): store.load_model(spark, root, "line", v) for v in LINES}
    found = store.score_pipelines(routed, models, "rid")
    wanted = score(routed, {("line", v): linear_predictor(w, c) for v, (w, c) in LINES.items()}, ["a", "b"])
    assert found.columns == wanted.columns
    mine, other = ({r.rid: r for r in df.collect()} for df in (found, wanted))
    assert len(mine) == 80 == found.count()
    for i, r in other.items():
        assert mine[i].score_error == r.score_error and r.score_error in (None, NOT_LOADED)
        assert mine[i].prediction == pytest.approx(r.prediction, abs=1e-6)
        assert mine[i].shadow_predictions == pytest.approx(r.shadow_predictions, abs=1e-6)


def test_pipelines_of_several_stages(spark, tmp_path):
    rows = training(spark).withColumn("label", (F.col("a") > F.col("b")).cast("int"))
    stages = [StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled")]
    model = store.fit_pipeline(rows, "label", ["a", "b"], stages)
    reached = store.measure(model, rows, "label", ["a", "b"], MulticlassClassificationEvaluator(metricName="accuracy"))
    store.save_model(spark, str(tmp_path), "sign", 1, model, ["a", "b"], {"accuracy": reached})
    assert store.read_card(spark, str(tmp_path), "sign", 1).metrics["accuracy"] == reached > 0.9
    routed = spark.createDataFrame([(1, "sign", 1, [], 2.0, -2.0), (2, "sign", 1, [], -2.0, 2.0)], KIND)
    found = store.score_pipelines(routed, {("sign", 1): store.load_model(spark, str(tmp_path), "sign", 1)}, "rid")
    assert {r.rid: r.prediction for r in found.collect()} == {1: 1.0, 2: 0.0}
    assert FAILED not in {r.score_error for r in found.collect()}
    assert store.score_pipelines(routed.limit(0), {}, "rid").count() == 0


def test_sketches_of_parts_merge_to_the_rank_error_stated(spark):
    rows = spark.range(40_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") % 11).cast("double").alias("w"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.when(F.col("id") % 10 < 3, "x").otherwise("y").alias("g"),
    )
    rows = rows.withColumn("v", F.when(F.col("v") % 50 > 0, F.col("v")).otherwise(F.when(F.col("v") % 100 > 0, F.lit(float("nan")))))
    kept = sketches.sketch_days(rows, ["v", "w"], "ts", ("g",), k=200)
    assert kept.count() == 28 * 2 * 2
    merged = sketches.merge_sketches(kept, ("g",))
    asked = sketches.read_quantiles(merged, [0.0, 0.1, 0.5, 0.99, 1.0])
    for feature in ("v", "w"):
        own = asked.filter(F.col("feature") == feature)
        gaps = sketches.rank_gaps(rows, own, feature, "value", ("g",)).collect()
        assert len(gaps) == 10 and max(r.gap for r in gaps) <= sketches.SURE * sketches.rank_error(200)
    counts = {(r.g, r.feature): r.n for r in merged.collect()}
    assert counts["x", "v"] == rows.filter("g = 'x' AND v IS NOT NULL AND NOT isnan(v)").count() and counts["y", "w"] == 28_000
    edges = sketches.sketch_edges(kept, 10, ("g",)).filter("feature = 'w' AND g = 'y'").orderBy("pos").collect()
    assert [r.edge for r in edges] == sorted({r.edge for r in edges}) and 7.0 in {r.edge for r in edges}


def test_gaps_are_zero_for_exact_values_and_large_for_others(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    asked = spark.createDataFrame([(0.5, 50.0), (0.5, 80.0), (0.0, 0.0)], "probability double, value double")
    assert [r.gap for r in sketches.rank_gaps(rows, asked, "v", "value").collect()] == pytest.approx([0.0, 0.3, 0.0])


def test_sketches_without_values(spark):
    nothing = spark.createDataFrame([], "v double, ts timestamp")
    assert sketches.sketch_edges(sketches.sketch_days(nothing, ["v"], "ts")).count() == 0


def test_models_are_fitted_on_a_view_folded_once(spark, monkeypatch):
    read, plain = [], store.fit_pipeline

    def fit(training, *rest):
        read.append(training.inputFiles())
        return plain(training, *rest)

    monkeypatch.setattr(store, "fit_pipeline", fit)
    assert catalog.pipeline_score(spark, "/root/testdata/sf0.001").count() > 0
    assert len(read) == len(catalog.STORED)
    assert read[0] and all(files == read[0] for files in read)
    assert not any("events.parquet" in f for f in read[0])
