"""Typed text encoding of feature values for key-value stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timefns import epoch_seconds_to_ntz, ntz_to_micros
from tidemark.spec import EVENT_TS, Feature, FeatureGroup, FeatureType

# Fixed value: prefix of the key format below.
KEY_PREFIX = "ff"


def entity_key(fg: FeatureGroup, entity: Column, prefix: str = KEY_PREFIX) -> Column:
    """``<prefix>:{<group>:<entity>}:v<version>``; the braces keep all values of
    one entity on one slot of a clustered store."""
    return F.concat(
        F.lit(f"{prefix}:{{{fg.name}:"), entity.cast("string"), F.lit(f"}}:v{fg.version}")
    )


def encode_value(feature: Feature, value: Column) -> Column:
    typed = value.cast(feature.spark_type)
    if feature.dtype is FeatureType.FLOAT_LIST:
        return F.to_json(typed)
    if feature.dtype is FeatureType.BOOL:
        return F.when(typed, "1").when(~typed, "0")
    return typed.cast("string")


def decode_value(feature: Feature | None, text: Column) -> Column:
    """Text back to the feature's type; text that does not parse gives null and
    a field outside the spec stays text."""
    if feature is None or feature.dtype is FeatureType.STRING:
        return text
    if feature.dtype is FeatureType.BOOL:
        return text == F.lit("1")
    if feature.dtype is FeatureType.FLOAT_LIST:
        return F.from_json(text, "array<double>")
    return text.try_cast(feature.spark_type)


def encode(fg: FeatureGroup, df: DataFrame, prefix: str = KEY_PREFIX) -> DataFrame:
    """Rows of typed features -> (key, fields map). A null value is an absent field."""
    entries = [
        F.struct(
            F.lit(EVENT_TS).alias("key"),
            (ntz_to_micros(F.col(EVENT_TS)) / F.lit(1e6)).cast("string").alias("value"),
        )
    ]
    entries += [
        F.struct(F.lit(f.name).alias("key"), encode_value(f, F.col(f.name)).alias("value"))
        for f in fg.features
    ]
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.select(
        entity_key(fg, F.col(fg.entity), prefix).alias("key"),
        F.map_from_entries(present).alias("fields"),
    )


def decode(
    fg: FeatureGroup,
    df: DataFrame,
    fields: str = "fields",
    names: list[str] | None = None,
    defaults: bool = True,
) -> DataFrame:
    """Replace a ``map<string,string>`` column by typed feature columns."""
    kept = [F.col(c) for c in df.columns if c != fields]
    out = []
    for name in names or fg.feature_names:
        spec = fg.feature(name)
        text = F.col(fields)[name]
        value = decode_value(spec, text)
        if defaults and spec is not None:
            value = F.when(text.isNull(), spec.default()).otherwise(value)
        out.append(value.alias(name))
    seconds = F.col(fields)[EVENT_TS].try_cast("double")
    return df.select(*kept, *out, epoch_seconds_to_ntz(seconds).alias(EVENT_TS))
