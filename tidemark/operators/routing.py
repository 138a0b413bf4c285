"""Which model version answers a request.

A small log of deployments is packed into one array per model and joined to the
requests, so routing is a column expression over each request. A log beyond
``SMALL_LOG`` rows is counted as such and swept instead (``operators.sweep``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import canary_bucket
from tidemark.operators.registry import active_deployments, deployment_intervals
from tidemark.operators.skew import side_table_join
from tidemark.operators.sweep import NO_DEPLOYMENT, NOT_SERVABLE, route_sweep
from tidemark.spec import CANARY, PRODUCTION, SHADOW

#: Deployments up to which a model's history is one array.
SMALL_LOG = 10_000


def _packed(deployments: DataFrame) -> DataFrame:
    """One row per model: its deployments as an array in order of their id."""
    fields = ["id", "model_version", "mode", "traffic_pct"]
    fields += [c for c in ("created_at", "valid_to") if c in deployments.columns]
    return deployments.groupBy("model_name").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("deployments")
    )


def active_at(
    requests: DataFrame,
    deployment_log: DataFrame,
    request_ts: str = "request_ts",
    model_col: str = "model_name",
) -> DataFrame:
    """Requests with ``deployments``: those in force at the request's own time."""
    packed = _packed(deployment_intervals(deployment_log)).withColumnRenamed(
        "model_name", model_col
    )
    joined = side_table_join(requests, packed, model_col, size_of=deployment_log)

    def in_force(d: Column) -> Column:
        started = d["created_at"] <= F.col(request_ts)
        return started & (d["valid_to"].isNull() | (F.col(request_ts) < d["valid_to"]))

    return joined.withColumn("deployments", F.filter("deployments", in_force))


def active_now(
    requests: DataFrame, deployment_log: DataFrame, model_col: str = "model_name"
) -> DataFrame:
    """Requests with ``deployments``: those in force at the end of the log."""
    active = active_deployments(deployment_log)
    packed = _packed(active).withColumnRenamed("model_name", model_col)
    return side_table_join(requests, packed, model_col, size_of=active)


def assign(
    requests: DataFrame, model_col: str = "model_name", entity_col: str = "entity_id"
) -> DataFrame:
    """Pick the primary and the shadows from a ``deployments`` array.

    Primary: the first canary whose share covers the entity's bucket, else
    production, else the first canary. Adds ``bucket``, ``model_version``,
    ``mode``, ``shadow_versions`` and ``route_error``.
    """
    all_of = F.col("deployments")

    def of_mode(mode: str) -> Column:
        return F.filter(all_of, lambda d: d["mode"] == mode)

    canaries = of_mode(CANARY)
    chosen = F.coalesce(
        F.get(F.filter(canaries, lambda d: F.col("bucket") < d["traffic_pct"]), F.lit(0)),
        F.get(of_mode(PRODUCTION), F.lit(0)),
        F.get(canaries, F.lit(0)),
    )
    error = F.when(
        all_of.isNull() | (F.size(all_of) == 0), F.lit(NO_DEPLOYMENT)
    ).when(F.col("__primary").isNull(), F.lit(NOT_SERVABLE))
    empty = F.array().cast("array<int>")
    shadows = F.array_distinct(
        F.transform(of_mode(SHADOW), lambda d: d["model_version"].cast("int"))
    )
    return (
        requests.withColumn("bucket", canary_bucket(F.col(model_col), F.col(entity_col)))
        .withColumn("__primary", chosen)
        .withColumns(
            {
                "model_version": F.col("__primary")["model_version"].cast("int"),
                "mode": F.col("__primary")["mode"],
                "shadow_versions": F.coalesce(shadows, empty),
                "route_error": error,
            }
        )
        .drop("__primary", "deployments")
    )


def route_requests(
    requests: DataFrame,
    deployment_log: DataFrame,
    request_ts: str | None = "request_ts",
    model_col: str = "model_name",
    entity_col: str = "entity_id",
    small_log: int = SMALL_LOG,
) -> DataFrame:
    """Route every request by the deployments in force at its time (or, with
    ``request_ts=None``, by those in force now). Logs of more than ``small_log`` rows
    (the count stops there) are swept."""
    if request_ts is not None and deployment_log.limit(small_log + 1).count() > small_log:
        bucket = canary_bucket(F.col(model_col), F.col(entity_col))
        return route_sweep(requests, deployment_log, bucket, request_ts, model_col)
    if request_ts is None:
        found = active_now(requests, deployment_log, model_col)
    else:
        found = active_at(requests, deployment_log, request_ts, model_col)
    return assign(found, model_col, entity_col)
