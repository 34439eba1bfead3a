"""Aggregate expressions, all combinable before a shuffle but for the exact medians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum wx / sum w; 0 without weight."""
    return F.coalesce(F.try_divide(F.sum(w * x), F.sum(w)), F.lit(0.0))


def weighted_geomean(x: Column, w: Column) -> Column:
    """exp(sum w ln x / sum w) over positive x; 0 without any."""
    ok = x > 0
    return F.coalesce(F.exp(F.try_divide(F.sum(F.when(ok, w * F.ln(F.when(ok, x)))), F.sum(F.when(ok, w)))), F.lit(0.0))


def median0(x: Column) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def stdev(x: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation at (n - 1) q."""
    return F.coalesce(F.percentile(x, F.lit(q)), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """0 for fewer than three pairs or a constant series."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when(F.count(a) < 3, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-12, spread)), F.lit(0.0)))


def mape(x: Column, reference: Column) -> Column:
    """Mean absolute percentage error; rows with reference 0 are left out."""
    return F.avg(F.abs(F.try_divide(x - reference, reference))) * 100


def share_true(c: Column) -> Column:
    """Percent of the non-null values that are true; 0 without any."""
    return F.coalesce(F.avg(c.cast("double")) * 100, F.lit(0.0))
