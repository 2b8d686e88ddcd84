"""Numeric helpers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Rounds halves up, as floor(x * 10**places + 1/2); a millionth of a unit of tolerance keeps halves stable whatever the order of a sum."""
    return F.floor(value * 10**places + 0.500001) / 10**places


def seconds(epoch: Column) -> Column:
    """Epoch seconds from a number that is seconds below 1e12 and milliseconds from there on."""
    return F.when(epoch < 10**12, epoch).otherwise(F.floor(epoch / 1000))


def corr(a: str | Column, b: str | Column) -> Column:
    """Correlation over the rows with both values, as an aggregate; NaN where one of them never changes, which F.corr divides by zero for, and null without rows."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (a, b))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))  # a variance of equal values can be rounding, not zero
    return F.when(constant, F.lit(math.nan)).otherwise(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def t_two_sided(t: float | None, freedom: float | None) -> float | None:
    """Probability that a Student t variable is at least as far from zero as t."""
    if t is None or freedom is None or math.isnan(t) or freedom <= 0:
        return None
    return _beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))


def t_quantile(share: float, freedom: float) -> float:
    """t that a Student variable stays within, on both sides, with this probability."""
    low, high = 0.0, 1.0
    while t_two_sided(high, freedom) > 1 - share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, freedom) > 1 - share else (low, middle)
    return (low + high) / 2


def p_value(t: Column, freedom: Column) -> Column:
    """t_two_sided of columns.  For tables of results, which have few rows: an Arrow batch of numbers, no built-in function has it."""

    @F.pandas_udf("double")
    def run(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) else t_two_sided(float(x), float(n)) for x, n in zip(t, freedom)], dtype="float64")

    return run(t.cast("double"), freedom.cast("double"))
