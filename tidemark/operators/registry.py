"""Rules over append-only logs of specs, models and deployments.

Spec log: (name, version, entity, ttl_seconds, features array<struct<name,dtype>>).
Deployment log: (id, model_name, model_version, mode, traffic_pct, created_at,
optionally retired_at); ``id`` grows with every deployment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import CANARY, PRODUCTION, SHADOW, FeatureGroup

SPEC_LOG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("entity", T.StringType()),
        T.StructField("ttl_seconds", T.LongType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("dtype", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def spec_log(spark: SparkSession, groups: list[FeatureGroup]) -> DataFrame:
    rows = [
        (
            g.name,
            g.version,
            g.entity,
            g.ttl_seconds,
            [(f.name, f.dtype.value) for f in g.features],
        )
        for g in groups
    ]
    return spark.createDataFrame(rows, SPEC_LOG)


def latest_version(log: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The row with the highest version per name, combined before the shuffle."""
    rest = [c for c in log.columns if c != name]
    newest = log.groupBy(name).agg(F.max_by(F.struct(*rest), version).alias("__row"))
    return newest.select(name, "__row.*").select(*log.columns)


def get_version(log: DataFrame, name: str, version: int | None = None) -> DataFrame:
    found = log.filter(F.col("name") == name)
    if version is None:
        return latest_version(found)
    return found.filter(F.col("version") == version)


def list_groups(log: DataFrame) -> DataFrame:
    """Every registered group version with its feature count and ttl, in order."""
    return log.select(
        "name", "version", "entity", F.size("features").alias("n_features"), "ttl_seconds"
    ).orderBy("name", "version")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per-feature changes between two spec logs: added, removed or retyped.

    Only names present on both sides are compared: a first registration is no change.
    """

    def features(log: DataFrame, dtype: str) -> DataFrame:
        return log.select("name", F.inline("features").alias("feature", dtype))

    both = features(old, "old_dtype").join(
        features(new, "new_dtype"), ["name", "feature"], "full"
    )
    known = old.select("name").distinct().join(new.select("name").distinct(), "name")
    change = (
        F.when(F.col("new_dtype").isNull(), "removed")
        .when(F.col("old_dtype").isNull(), "added")
        .when(F.col("old_dtype") != F.col("new_dtype"), "retyped")
    )
    return (
        both.join(known, "name", "left_semi")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("name", "feature", "change", "old_dtype", "new_dtype")
    )


def check_compatible(old: FeatureGroup, new: FeatureGroup) -> None:
    """Within one version features may be added; removing or retyping is refused."""
    before = {f.name: f.dtype for f in old.features}
    after = {f.name: f.dtype for f in new.features}
    removed = sorted(before.keys() - after.keys())
    retyped = sorted(n for n in before.keys() & after.keys() if before[n] != after[n])
    if removed or retyped:
        raise ValueError(
            f"{new.name} v{new.version}: removed {removed}, retyped {retyped}; "
            "register a new version"
        )


def lineage(models: DataFrame, specs: DataFrame) -> DataFrame:
    """Model version -> feature group -> feature, on the latest group versions.

    ``models`` rows: (name, version, feature_groups array<string>). A group that
    is not registered is kept with null version and feature.
    """
    needs = models.select(
        F.col("name").alias("model_name"),
        F.col("version").alias("model_version"),
        F.explode("feature_groups").alias("feature_group"),
    )
    groups = latest_version(specs).select(
        F.col("name").alias("feature_group"),
        F.col("version").alias("group_version"),
        F.explode_outer("features.name").alias("feature"),
    )
    return needs.join(groups, "feature_group", "left").select(
        "model_name", "model_version", "feature_group", "group_version", "feature"
    )


def active_deployments(log: DataFrame) -> DataFrame:
    """Deployments in force: the newest production of each model supersedes earlier
    ones; canaries and shadows stay until retired."""
    rest = [c for c in log.columns if c != "model_name"]
    production = (
        log.filter(F.col("mode") == PRODUCTION)
        .groupBy("model_name")
        .agg(F.max_by(F.struct(*rest), "id").alias("__row"))
        .select("model_name", "__row.*")
        .select(*log.columns)
    )
    active = production.unionByName(log.filter(F.col("mode").isin(CANARY, SHADOW)))
    if "retired_at" in log.columns:
        active = active.filter(F.col("retired_at").isNull())
    return active


def deployment_intervals(log: DataFrame) -> DataFrame:
    """Add ``valid_to``: a production ends when the model's next one starts; canaries
    and shadows are open-ended unless retired."""
    by_model = W.partitionBy("model_name", "mode").orderBy("created_at", "id")
    following: Column = F.lead("created_at").over(by_model)
    ends = F.when(F.col("mode") == PRODUCTION, following)
    if "retired_at" in log.columns:
        ends = F.least(ends, F.col("retired_at"))
    return log.withColumn("valid_to", ends)
