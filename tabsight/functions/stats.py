"""Statistical column expressions shared by the operators.

* bias-adjusted sample skewness / excess kurtosis (Spark's built-ins are the
  population moments);
* shares in percent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def adjusted_skewness(c) -> Column:
    """Sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2); NULL for n < 3 or constant input."""
    x = _c(c).cast("double")
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c) -> Column:
    """Sample excess kurtosis G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); NULL for n < 4."""
    x = _c(c).cast("double")
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pct(num, den, digits: int = 2) -> Column:
    """round(num / den * 100, digits); NULL when den is 0."""
    return F.round(_c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0)) * 100,
                   digits)
