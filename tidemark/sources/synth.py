"""Synthetic activity features for load tests, one row per entity of a table.

Every value is a function of (entity, seed), so the result does not depend on how
the entities are partitioned and a re-run task repeats its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timefns import as_of_literal
from tidemark.spec import EVENT_TS


def uniform(entity: Column, seed: int, stream: str) -> Column:
    """Uniform in [0, 1) from 32 bits of a digest."""
    digest = F.md5(F.concat(entity.cast("string"), F.lit(f"|{seed}|{stream}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def poisson(u: Column, mean: float) -> Column:
    """Inverse-CDF Poisson; the tail beyond double precision is not reachable."""
    cdf, term, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1.0 - 2.0**-33:
        total += term
        cdf.append(total)
        k += 1
        term *= mean / k
    steps = F.array(*[F.lit(c) for c in cdf])
    return F.size(F.filter(steps, lambda c: c <= u)).cast("bigint")


@dataclass(frozen=True)
class Draw:
    """How a feature is drawn: ``poisson`` with a mean, ``exponential`` with a mean, or
    ``below``, a whole number under ``size``."""

    kind: str
    size: float

    def of(self, u: Column) -> Column:
        if self.kind == "poisson":
            return poisson(u, self.size)
        if self.kind == "exponential":
            return -F.lit(float(self.size)) * F.ln(F.lit(1.0) - u)
        if self.kind == "below":
            return F.floor(u * self.size).cast("bigint")
        raise ValueError(f"unknown kind {self.kind!r}")


@dataclass(frozen=True)
class Score:
    """A 0/1 label: whether a weighted sum of features plus normal noise is above zero."""

    name: str
    weights: dict[str, float]
    noise: float


VISITS = {"visits": Draw("poisson", 4.0), "minutes": Draw("exponential", 25.0), "idle_days": Draw("below", 60)}
LEAVES = Score("leaves", {"visits": -0.7, "minutes": -0.02, "idle_days": 0.08}, 0.8)


def synth_features(
    entities: DataFrame,
    entity: str,
    as_of: object,
    recipe: dict[str, Draw] | None = None,
    label: Score | None = LEAVES,
    seed: int = 42,
) -> DataFrame:
    """Features drawn by ``recipe``, an event time within the day before ``as_of``, and the
    label. Every value is a function of entity, seed and feature name."""

    def u(stream: str) -> Column:
        return uniform(F.col(entity), seed, stream)

    drawn = {name: draw.of(u(name)).alias(name) for name, draw in (recipe or VISITS).items()}
    seconds = -F.floor(u("time") * 86400).cast("bigint")
    rows = entities.select(entity).distinct().select(
        entity, *drawn.values(), F.timestamp_add("SECOND", seconds, as_of_literal(as_of)).alias(EVENT_TS)
    )
    if label is None:
        return rows
    # Two uniform numbers make a normal one.
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u("noise_r")))
    score = F.lit(label.noise) * radius * F.cos(F.lit(2.0 * math.pi) * u("noise_a"))
    for name, weight in label.weights.items():
        score = score + F.lit(weight) * F.col(name)
    return rows.withColumn(label.name, (score > 0).cast("int"))
