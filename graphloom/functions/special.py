"""Distribution functions that Spark lacks, as Arrow-batched functions on columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not (a > 0 and b > 0) or x != x:
        return float("nan")
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t."""
    if t != t or df != df or df <= 0:
        return float("nan")
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0
    return tail if t > 0 else 1 - tail


def pearson_p(r: float, n: float) -> float:
    """The two-sided p of a correlation of n pairs."""
    return float("nan") if r != r or n < 3 else min(1.0, 2 * betainc(n / 2 - 1, n / 2 - 1, 0.5 * (1 - min(1.0, abs(r)))))


def normal_cdf_of(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.asarray(x, float)])


@pandas_udf(DoubleType())
def student_t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)]).where(t.notna() & df.notna(), None)


@pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_p(a, b) for a, b in zip(r.astype(float), n.astype(float), strict=True)])


@pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf_of(x))


@pandas_udf(DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([betainc(p, q, v) for v, p, q in zip(x, a, b, strict=True)])
