"""Fitted Spark pipelines as versions of a model, kept with what was measured on them.

``<root>/<name>/v<version>/model`` is the saved ``PipelineModel``; ``card.json`` beside it is
written last, so that a version exists once its card does. A pipeline takes the column
``features`` (``scoring.feature_vector`` in the order of the card) and adds ``prediction``.

``score_pipelines`` runs every request through the version it was routed to. Requests are
written once, split by model and version, and each part is read by its own pipeline: a
version sees its own requests only, and no request carries columns of other versions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.files import Files
from tidemark.operators.scoring import FAILED, NOT_LOADED, feature_vector
from tidemark.workspace import new_run_dir

CARD = "name string, version int, order array<string>, metrics map<string,double>, uri string"


@dataclass(frozen=True)
class Card:
    name: str
    version: int
    order: tuple[str, ...]
    metrics: dict[str, float] = field(default_factory=dict)
    uri: str = ""


@dataclass(frozen=True)
class Stored:
    card: Card
    model: PipelineModel


def features(rows: DataFrame, order: tuple[str, ...], overrides: str | None = None) -> DataFrame:
    return rows.withColumn("features", array_to_vector(feature_vector(list(order), overrides)))


def fit_pipeline(training: DataFrame, label: str, order: list[str], stages: list[Estimator]) -> PipelineModel:
    """Fit ``stages`` on a training table; they read ``features`` and ``label``."""
    rows = features(training, tuple(order)).select("features", F.col(label).cast("double").alias("label"))
    return Pipeline(stages=stages).fit(rows)


def measure(model: PipelineModel, data: DataFrame, label: str, order: list[str], evaluator: Evaluator) -> float:
    rows = features(data, tuple(order)).select("features", F.col(label).cast("double").alias("label"))
    return float(evaluator.evaluate(model.transform(rows)))


def _folder(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{name}/v{version}"


def save_model(
    spark: SparkSession, root: str, name: str, version: int, model: PipelineModel, order: list[str], metrics: dict[str, float]
) -> Card:
    """Add a version. A version is never replaced: what was measured belongs to what was saved."""
    files, folder = Files(spark), _folder(root, name, version)
    if files.exists(f"{folder}/card.json"):
        raise ValueError(f"{name} v{version} exists; register a new version")
    # What an interrupted save has left is written over.
    model.write().overwrite().save(f"{folder}/model")
    card = Card(name, version, tuple(order), dict(metrics), f"{folder}/model")
    files.write(f"{folder}/card.json", json.dumps(asdict(card)))
    return card


def read_card(spark: SparkSession, root: str, name: str, version: int) -> Card:
    found = json.loads(Files(spark).read(f"{_folder(root, name, version)}/card.json"))
    return Card(found["name"], found["version"], tuple(found["order"]), found["metrics"], found["uri"])


def load_model(spark: SparkSession, root: str, name: str, version: int) -> Stored:
    card = read_card(spark, root, name, version)
    return Stored(card, PipelineModel.load(card.uri))


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """The cards of all versions: name, version, order, metrics, uri."""
    files = Files(spark)
    cards = []
    for name in files.names(root):
        for v in files.names(f"{root}/{name}"):
            if files.exists(f"{root}/{name}/{v}/card.json"):
                c = read_card(spark, root, name, int(v.removeprefix("v")))
                cards.append((c.name, c.version, list(c.order), c.metrics, c.uri))
    return spark.createDataFrame(cards, CARD)


def best_version(spark: SparkSession, root: str, name: str, metric: str, larger: bool = True) -> int | None:
    """The version with the best value of a metric (the newest of equals)."""
    order = F.struct(F.col("value") if larger else -F.col("value"), "version")
    rows = list_models(spark, root).filter(F.col("name") == name).withColumn("value", F.col("metrics")[metric])
    return rows.filter(F.col("value").isNotNull()).agg(F.max_by("version", order)).first()[0]


_KEY, _MODEL, _VERSION, _SHADOW = "__key", "__model", "__version", "__shadow"


def score_pipelines(
    routed: DataFrame,
    models: Mapping[tuple[str, int], Stored],
    key: str,
    model_col: str = "model_name",
    overrides: str | None = None,
) -> DataFrame:
    """``routed`` with ``prediction``, ``score_error`` and ``shadow_predictions`` (a map from
    ``v<version>``), as ``scoring.score`` has them.

    ``key`` is a column that tells requests apart. A shadow without a stored model has no
    entry; a primary without one is an error of its request.
    """
    spark = routed.sparkSession
    path = new_run_dir(spark, "requests")
    known = {}
    for name, version in models:
        known.setdefault(name, []).append(version)
    watched = F.lit(None).cast("array<int>")
    for name, versions in known.items():
        mine = F.array_intersect("shadow_versions", F.array(*[F.lit(v).cast("int") for v in versions]))
        watched = F.when(F.col(model_col) == name, mine).otherwise(watched)
    # The request for its own version (-1: none), and once for each shadow that is stored.
    primary = F.array(F.struct(F.coalesce(F.col("model_version"), F.lit(-1)).alias("v"), F.lit(False).alias("s")))
    shadows = F.transform(F.coalesce(watched, F.array().cast("array<int>")), lambda v: F.struct(v.alias("v"), F.lit(True).alias("s")))
    runs = routed.select("*", F.explode(F.concat(primary, shadows)).alias("__run"))
    runs = runs.withColumns({_MODEL: F.col(model_col), _VERSION: F.col("__run.v"), _SHADOW: F.col("__run.s"), _KEY: F.col(key)}).drop("__run")
    runs.write.partitionBy(_MODEL, _VERSION).parquet(path)
    split = spark.read.schema(runs.schema).parquet(path)

    stored = F.lit(False)
    parts = []
    for (name, version), found in models.items():
        here = (F.col(_MODEL) == name) & (F.col(_VERSION) == version)
        stored = stored | here
        rows = features(split.filter(here), found.card.order, overrides)
        scored = found.model.transform(rows)
        parts.append(scored.select(*split.columns, F.col("prediction").cast("double").alias("prediction"), F.lit(True).alias("__loaded")))
    rest = split.filter(~F.coalesce(stored, F.lit(False)))
    out = rest.select("*", F.lit(None).cast("double").alias("prediction"), F.lit(False).alias("__loaded"))
    for p in parts:
        out = out.unionByName(p)

    entry = F.struct(F.concat(F.lit("v"), _VERSION).alias("key"), F.col("prediction").alias("value"))
    seen = out.filter(F.col(_SHADOW) & F.col("prediction").isNotNull()).groupBy(_KEY)
    shadow = seen.agg(F.map_from_entries(F.collect_list(entry)).alias("shadow_predictions"))
    answered = out.filter(~F.col(_SHADOW)).join(shadow, _KEY, "left")
    error = F.when(F.col("model_version").isNotNull() & ~F.col("__loaded"), F.lit(NOT_LOADED)).when(
        F.col("__loaded") & F.col("prediction").isNull(), F.lit(FAILED)
    )
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    return answered.select(
        *[F.col(f"`{c}`") for c in routed.columns],
        "prediction",
        error.alias("score_error"),
        F.coalesce("shadow_predictions", empty).alias("shadow_predictions"),
    )
