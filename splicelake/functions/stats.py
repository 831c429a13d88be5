"""Aggregate expressions that stay defined on constant or single-row groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation; null when either side is constant (no division happens there)."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 0) & (sb > 0), F.covar_pop(a, b) / (sa * sb))
