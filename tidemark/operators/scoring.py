"""Batch scoring of routed requests, and training on point-in-time features."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A predictor turns the feature vector column into a prediction column.
Predictor = Callable[[Column], Column]

NOT_LOADED = "model version not loaded"
FAILED = "prediction failed"


def feature_vector(order: list[str], overrides: str | None = None) -> Column:
    """Features in model order as doubles; a missing one counts as 0.0.

    ``overrides`` names a ``map<string,double>`` column whose entries win.
    """
    values = []
    for name in order:
        value = F.col(name).cast("double")
        if overrides is not None:
            value = F.coalesce(F.col(overrides)[name].cast("double"), value)
        values.append(F.coalesce(value, F.lit(0.0)))
    return F.array(*values)


def linear_predictor(weights: list[float], intercept: float = 0.0) -> Predictor:
    """A linear model as a plain column expression."""

    def predict(vector: Column) -> Column:
        total = F.lit(float(intercept))
        for i, w in enumerate(weights):
            total = total + vector[i] * F.lit(float(w))
        return total

    return predict


def array_predictor(predict: Callable[[np.ndarray], np.ndarray]) -> Predictor:
    """Any model with a vectorised ``predict(matrix)``, run on Arrow batches.

    Null vectors (rows that belong to another version) are not shown to the model. Where
    it raises, the batch is halved until only the rows that fail are left; those get null.
    """

    def scored(matrix: np.ndarray) -> np.ndarray:
        try:
            return np.asarray(predict(matrix), dtype="float64").reshape(len(matrix))
        except Exception:  # noqa: BLE001  a model's failure concerns its own rows only
            if len(matrix) == 1:
                return np.full(1, np.nan)
            half = len(matrix) // 2
            return np.concatenate([scored(matrix[:half]), scored(matrix[half:])])

    def per_batch(vectors: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=vectors.index, dtype="float64")
        mine = vectors.notna()
        if mine.any():
            out[mine] = scored(np.stack(vectors[mine].to_numpy()))
        return out

    udf = F.pandas_udf(per_batch, T.DoubleType())

    def column(vector: Column) -> Column:
        value = F.when(vector.isNotNull(), udf(vector))
        return F.when(~F.isnan(value), value)

    return column


def score(
    routed: DataFrame,
    predictors: Mapping[tuple[str, int], Predictor],
    order: list[str] | Mapping[tuple[str, int], list[str]],
    model_col: str = "model_name",
    overrides: str | None = None,
) -> DataFrame:
    """Score each request with its assigned version and with every shadow.

    ``order`` is the feature order of all versions, or one list per version.

    Adds ``prediction``, ``score_error`` and ``shadow_predictions``, a map from
    ``v<version>`` to the shadow's value. A shadow that is not loaded or fails
    (null) has no entry and never affects the request; a primary that fails is an
    error of its request. Each version is run once, on the requests that it answers
    or watches.
    """
    orders = order if isinstance(order, Mapping) else dict.fromkeys(predictors, order)
    distinct = {tuple(names) for names in orders.values()}
    columns = {names: feature_vector(list(names), overrides) for names in distinct}
    vectors = {version: columns[tuple(names)] for version, names in orders.items()}
    primary = F.lit(None).cast("double")
    loaded = F.lit(False)
    shadows = []
    for (model, version), predict in predictors.items():
        is_model = F.col(model_col) == model
        mine = is_model & (F.col("model_version") == version)
        vector = vectors[model, version]
        watched = is_model & F.array_contains("shadow_versions", F.lit(version))
        value = predict(F.when(mine | watched, vector)).cast("double")
        primary = F.when(mine, value).otherwise(primary)
        loaded = loaded | mine
        shadows.append(
            F.struct(F.lit(f"v{version}").alias("key"), F.when(watched, value).alias("value"))
        )
    succeeded = F.filter(F.array(*shadows), lambda s: s["value"].isNotNull())
    return routed.withColumns(
        {
            "prediction": primary,
            "score_error": F.when(
                F.col("model_version").isNotNull() & ~F.coalesce(loaded, F.lit(False)),
                F.lit(NOT_LOADED),
            ).when(loaded & primary.isNull(), F.lit(FAILED)),
            "shadow_predictions": F.map_from_entries(succeeded),
        }
    )


def train_gbt(
    training: DataFrame,
    label: str,
    order: list[str],
    trees: int = 50,
    depth: int = 3,
    seed: int = 42,
) -> GBTClassificationModel:
    """Gradient-boosted trees on a training table (usually a point-in-time join)."""
    rows = training.select(
        array_to_vector(feature_vector(order)).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(rows)


def accuracy(
    model: GBTClassificationModel, data: DataFrame, label: str, order: list[str]
) -> float:
    rows = data.select(
        array_to_vector(feature_vector(order)).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(
        model.transform(rows)
    )
