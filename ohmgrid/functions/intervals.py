"""Expressions over intervals and their uncertainty: overlap classes, log intervals, combined deviations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(low1: str, high1: str, low2: str, high2: str) -> Column:
    """strong_overlap (half of the shorter one or more), partial_overlap, near_miss (a gap no wider than the shorter one),
    far_miss or missing_interval."""
    a, b, c, d = map(F.col, (low1, high1, low2, high2))
    bad = a.isNull() | b.isNull() | c.isNull() | d.isNull() | (a > b) | (c > d)
    common, shorter = F.least(b, d) - F.greatest(a, c), F.least(b - a, d - c)
    return F.when(bad, "missing_interval").when(common >= 0, F.when(common >= 0.5 * shorter, "strong_overlap").otherwise("partial_overlap")).when(-common <= shorter, "near_miss").otherwise("far_miss")


def log_interval(value: Column, sigma: Column, k: float = 1.0) -> Column:
    """(low, high): value divided and multiplied by exp(k sigma); null unless value is positive."""
    spread = F.exp(k * sigma)
    return F.when(value > 0, F.struct((value / spread).alias("low"), (value * spread).alias("high")))


def combined_sigma(*sigmas: Column) -> Column:
    """Root of the sum of squares of those that are known; null if none is."""
    known = sum((F.coalesce(s * s, F.lit(0.0)) for s in sigmas), F.lit(0.0))
    return F.when(F.coalesce(*sigmas).isNotNull(), F.sqrt(known))
