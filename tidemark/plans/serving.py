"""Batch serving: requests to a scored log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timefns import age_seconds
from tidemark.operators.latest import attach_features, features_for_model
from tidemark.operators.pit import point_in_time_join
from tidemark.operators.routing import route_requests
from tidemark.operators.scoring import Predictor, score
from tidemark.operators.skew import HOT_ROWS
from tidemark.spec import FeatureGroup, ModelVersion

NOT_FOUND = "model not found"


def serve(
    requests: DataFrame,
    deployment_log: DataFrame,
    model: ModelVersion,
    views: dict[str, tuple[FeatureGroup, DataFrame]],
    predictors: Mapping[tuple[str, int], Predictor],
    order: list[str],
    request_ts: str | None = "request_ts",
    entity_col: str = "entity_id",
    overrides: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach the latest features to requests, route them, score primary and shadows.

    Routing and scoring are expressions over each joined row, so they come last and
    run once per request. ``feature_age_seconds`` maps a group to the age of its
    features at the request; ``overrides`` names a map column of feature values that
    win over the stored ones.
    """
    features = features_for_model(model, requests.select(entity_col), views, entity_col)
    attached = attach_features(requests, features, entity_col, hot_rows)
    routed = route_requests(attached, deployment_log, request_ts, entity_col=entity_col)
    if request_ts is not None:
        routed = routed.withColumn(
            "feature_age_seconds", feature_ages(model, views, F.col(request_ts))
        )
    return score(routed, predictors, order, overrides=overrides)


def serve_at_request(
    requests: DataFrame,
    deployment_log: DataFrame,
    models: Sequence[ModelVersion],
    groups: Mapping[str, tuple[FeatureGroup, DataFrame | None]],
    predictors: Mapping[tuple[str, int], Predictor],
    request_ts: str = "request_ts",
    entity_col: str = "entity_id",
    overrides: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Score each request with what was known at its own time.

    The routed version, and each shadow, gets the features of its own groups, in the
    order of its entry in ``models`` (the model log). ``groups`` holds feature rows, not
    the latest view: values are joined as of ``request_ts``, so a replayed log sees
    nothing of its future, and values older than a group's ttl count as absent. Columns
    and overrides are named ``<group>__<feature>``. A version without an entry is an
    error of its requests.
    """
    known = {(m.name, m.version): m for m in models}
    used = [n for n in groups if any(n in m.feature_groups for m in models)]
    joined = point_in_time_join(
        requests, [groups[n] for n in used], entity_col, request_ts, prefix=True, hot_rows=hot_rows
    )
    now = F.col(request_ts)
    columns: dict[str, Column] = {}
    ages = []
    for name in used:
        fg = groups[name][0]
        age = age_seconds(F.col(f"_ts_{name}"), now)
        fresh = age.isNotNull() if fg.ttl_seconds <= 0 else age < fg.ttl_seconds
        for f in fg.features:
            column = f"{name}__{f.name}"
            columns[column] = F.coalesce(F.when(fresh, F.col(column)), f.default())
        ages.append(F.struct(F.lit(name).alias("group"), F.when(fresh, age).alias("age")))
    empty = F.create_map().cast("map<string,double>")
    found = F.map_from_entries(F.filter(F.array(*ages), lambda a: a["age"].isNotNull())) if ages else empty
    attached = joined.withColumns(columns | {"feature_age_seconds": found})
    routed = route_requests(attached, deployment_log, request_ts, entity_col=entity_col)
    orders = {
        key: [f"{g}__{f.name}" for g in m.feature_groups if g in groups for f in groups[g][0].features]
        for key, m in known.items()
    }
    loaded = {key: p for key, p in predictors.items() if key in known}
    scored = score(routed, loaded, {key: orders[key] for key in loaded}, overrides=overrides)
    listed = F.lit(False)
    for name, version in known:
        listed = listed | ((F.col("model_name") == name) & (F.col("model_version") == version))
    missing = F.col("model_version").isNotNull() & ~listed
    return scored.withColumn("score_error", F.when(missing, F.lit(NOT_FOUND)).otherwise(F.col("score_error")))


def feature_ages(
    model: ModelVersion, views: Mapping[str, tuple[FeatureGroup, DataFrame]], as_of: object
) -> Column:
    """Map from group to seconds since its features' event time; groups without
    features for the entity are left out."""
    ages = [
        F.struct(
            F.lit(name).alias("group"), age_seconds(F.col(f"_ts_{name}"), as_of).alias("age")
        )
        for name in model.feature_groups
        if name in views
    ]
    return F.map_from_entries(F.filter(F.array(*ages), lambda a: a["age"].isNotNull()))
