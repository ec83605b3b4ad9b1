"""Aggregates in the sample-corrected forms used by dataframe libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import c, ratio


def sample_skew(x) -> Column:
    x = c(x)
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(x) -> Column:
    """Excess kurtosis with the small-sample correction."""
    x = c(x)
    n = F.count(x)
    return F.when(
        n >= 4,
        ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)),
    )


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


#: A side whose deviation is below this share of its mean size counts as constant: its correlation would be rounding noise.
FLAT = 1e-6


def safe_corr(x, y) -> Column:
    """Pearson correlation within [-1, 1], null when either side is constant (``FLAT``) or fewer than two pairs exist."""
    x, y = c(x), c(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    r = F.covar_samp(x, y) / (sx * sy)
    return F.when((sx > FLAT * F.avg(F.abs(x))) & (sy > FLAT * F.avg(F.abs(y))), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def mean_where(cond: Column, x) -> Column:
    return F.avg(F.when(cond, c(x)))


def sharpe(r, rf: float = 0.02, periods: int = 252) -> Column:
    """Annualised excess mean over annualised volatility; 0 for a flat or one-row series."""
    r = c(r)
    daily = (1 + rf) ** (1 / periods) - 1
    sd = F.stddev_samp(r)
    return F.when(sd > 0, (F.avg(r) - daily) / sd * (periods**0.5)).otherwise(0.0)


def total_growth(r) -> Column:
    from .windows import compounded

    return compounded(r, None)


__all__ = ["sample_skew", "sample_kurtosis", "count_if", "safe_corr", "mean_where", "sharpe", "total_growth", "ratio"]
