"""Declarative metadata: feature groups, model versions and deployments.

Specs are small immutable Python objects that live on the driver. They never
hold data; they tell the operators which columns exist and how they are typed.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from enum import StrEnum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: names of groups and features.
_NAME = re.compile(r"[a-z][a-z0-9_]{0,62}")

EVENT_TS = "_event_ts"
INGEST_TS = "_ingest_ts"
WRITE_TS = "_write_ts"
SEQ = "_seq"


class FeatureType(StrEnum):
    """The closed set of feature types."""

    INT64 = "int64"
    FLOAT64 = "float64"
    STRING = "string"
    BOOL = "bool"
    FLOAT_LIST = "float_list"

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPES[self]


_SPARK_TYPES = {
    FeatureType.INT64: T.LongType(),
    FeatureType.FLOAT64: T.DoubleType(),
    FeatureType.STRING: T.StringType(),
    FeatureType.BOOL: T.BooleanType(),
    FeatureType.FLOAT_LIST: T.ArrayType(T.DoubleType()),
}


def _require_name(kind: str, name: str) -> None:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{kind} name {name!r} must match {_NAME.pattern}")


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: FeatureType
    description: str = ""
    default_value: Any = None

    def __post_init__(self) -> None:
        _require_name("feature", self.name)
        object.__setattr__(self, "dtype", FeatureType(self.dtype))

    @property
    def spark_type(self) -> T.DataType:
        return self.dtype.spark_type

    def struct_field(self) -> T.StructField:
        return T.StructField(
            self.name,
            self.spark_type,
            True,
            {"description": self.description, "default": self.default_value},
        )

    def default(self) -> Column:
        """The default as a typed literal (null when the spec has none)."""
        value = self.default_value
        if value is not None and self.dtype is FeatureType.FLOAT_LIST:
            return F.array(*[F.lit(float(v)) for v in value]).cast(self.spark_type)
        return F.lit(value).cast(self.spark_type)


@dataclass(frozen=True)
class FeatureGroup:
    """A versioned set of features that share one entity key.

    ``entity_dtype`` is optional; without it the entity's type is read from the
    stored files.
    """

    name: str
    entity: str
    features: tuple[Feature, ...]
    version: int = 1
    ttl_seconds: int = 86400
    source: str = ""
    owner: str = ""
    description: str = ""
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    entity_dtype: FeatureType | None = None

    def __post_init__(self) -> None:
        _require_name("feature group", self.name)
        object.__setattr__(self, "features", tuple(self.features))
        if self.entity_dtype is not None:
            object.__setattr__(self, "entity_dtype", FeatureType(self.entity_dtype))
        names = self.feature_names
        if len(set(names)) != len(names):
            raise ValueError(f"feature group {self.name!r} repeats a feature name")

    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def table_name(self) -> str:
        return f"{self.name}_v{self.version}"

    def feature(self, name: str) -> Feature | None:
        return next((f for f in self.features if f.name == name), None)

    def schema(self) -> T.StructType:
        """Feature columns only, with defaults and descriptions as metadata."""
        return T.StructType([f.struct_field() for f in self.features])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FeatureGroup:
        raw = json.loads(text)
        features = tuple(Feature(**f) for f in raw.pop("features"))
        return cls(features=features, **raw)


@dataclass(frozen=True)
class ModelVersion:
    name: str
    version: int
    feature_groups: tuple[str, ...]
    artifact_uri: str = ""
    metrics: dict[str, float] = field(default_factory=dict)
    description: str = ""


# Deployment modes.
PRODUCTION = "production"
CANARY = "canary"
SHADOW = "shadow"
