"""Overflow marks, half-up bins, per-file current limits and flag arrays of measurement points.

Defined results: overflow marks (1e30 or more in size) and nulls become null and never fail a filter that keeps nulls;
empty tables give empty results; extra columns are kept unless named otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1e30
CHANNELS = ("v_gate", "i_gate", "v_drain", "i_drain")


def valid(c: Column | str) -> Column:
    """c without overflow marks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < LIMIT, c)


def cleaned(points: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    return points.withColumns({c: valid(c) for c in channels})


def half_up(c: Column | str, digits: int) -> Column:
    """c rounded half away from zero on its decimal digits, as a double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(28,9)"), digits).cast("double")


def ladder(c: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step (upper bound, label) that c does not exceed."""
    out = F.lit(last)
    for bound, label in reversed(steps):
        out = F.when(c <= bound, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def largest_current(points: DataFrame) -> DataFrame:
    """(metadata_id, max_abs_i_drain): the limit that a file ran into, if any."""
    return points.groupBy("metadata_id").agg(F.max(F.abs(valid("i_drain"))).alias("max_abs_i_drain"))


def below_compliance(points: DataFrame, share: float = 0.99) -> DataFrame:
    """Points whose drain current is null or below share of the largest of their file."""
    joined = points.join(largest_current(points), "metadata_id", "left")
    i = F.col("i_drain")
    return joined.filter(i.isNull() | F.col("max_abs_i_drain").isNull() | (F.abs(i) < share * F.col("max_abs_i_drain")))


def flags(**conditions: Column) -> Column:
    """An array of the names whose condition holds; null conditions don't."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))
