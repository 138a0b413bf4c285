"""Deterministic traffic buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canary_bucket(model: Column, entity: Column) -> Column:
    """SHA-256 of ``model:entity`` read as one big number, modulo 100.

    The 256-bit number does not fit a SQL integer, so it is folded eight hex
    digits at a time; every intermediate value stays below 100 * 2**32. Null in
    either argument gives null.
    """
    text = F.concat(model.cast("string"), F.lit(":"), entity.cast("string"))
    digest = F.sha2(text, 256)
    rest = F.lit(0).cast("bigint")
    for start in range(1, 65, 8):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * 2**32 + chunk) % 100
    return rest.cast("int")
