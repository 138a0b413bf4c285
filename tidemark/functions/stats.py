"""Upper tail of the chi-square distribution for small result tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _upper_gamma() -> Callable[[float, float], float]:
    # A local function travels to the executors by value; they need no copy of
    # this package.
    def upper_gamma(a: float, x: float) -> float:
        """Regularised upper incomplete gamma Q(a, x): power series below the mean,
        continued fraction above."""
        if x <= 0.0:
            return 1.0
        scale = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1.0:
            term = total = 1.0 / a
            n = a
            while term > total * 1e-17:
                n += 1.0
                term *= x / n
                total += term
            return max(0.0, 1.0 - scale * total)
        b = x + 1.0 - a
        c = 1e300
        d = 1.0 / b
        value = d
        i = 0
        step = 0.0
        while abs(step - 1.0) > 1e-15:
            i += 1
            numerator = -i * (i - a)
            b += 2.0
            d = numerator * d + b
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = b + numerator / c
            c = c if abs(c) > 1e-300 else 1e-300
            step = c * d
            value *= step
        return min(1.0, scale * value)

    return upper_gamma


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic). Meant for one row per tested feature, not for data rows."""
    tail = _upper_gamma()

    def per_batch(x: pd.Series, k: pd.Series) -> pd.Series:
        values = [tail(ki / 2.0, xi / 2.0) for xi, ki in zip(x, k, strict=True)]
        return pd.Series(values, dtype="float64")

    return F.pandas_udf(per_batch, T.DoubleType())(statistic, dof)
