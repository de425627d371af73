"""Predictions from nearest donors, with grouped validation and gates.

Donors share exact keys with the target row (an equi-join), lie nearest by the root mean square of scaled differences over
the features both have, and vote by a weighted median. Validation predicts each row from the others, those of its own
group left out in the join's condition.

Defined results: a row with fewer than the least donors has no prediction; donors without the target value are left out;
ties of distance go to the lower id; null features are not shared; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.operators.statistics import weighted_quantile


def predictions(rows: DataFrame, donors: DataFrame, on: list[str], features: list[str], scales: dict[str, float], key: str, target: str, k: int = 7, least: int = 3, apart: str | None = None) -> DataFrame:
    """(key, p10, p50, p90, donors, distance); with apart, donors of the same value of that column are left out."""
    extra = [apart] if apart else []
    d = donors.filter(F.col(target).isNotNull()).select(*on, F.col(key).alias("_id"), F.col(target).alias("_y"), *(F.col(f).alias(f"_{f}") for f in features), *(F.col(a).alias("_apart") for a in extra))
    j = rows.select(*dict.fromkeys([*on, key, *features, *extra])).join(d, on).filter(F.col(key) != F.col("_id"))
    if apart:
        j = j.filter(~F.col(apart).eqNullSafe(F.col("_apart")))
    terms = [F.pow((F.col(f) - F.col(f"_{f}")) / scales[f], 2) for f in features]
    shared = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
    distance = F.sqrt(sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)) / shared)
    near = j.filter(shared > 0).withColumn("distance", distance)
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("distance", "_id"))).filter(F.col("_n") <= k)
    near = near.withColumn("_w", 1 / F.greatest(F.col("distance"), F.lit(0.05)))
    stats = near.groupBy(key).agg(F.count("*").alias("donors"), F.avg("distance").alias("distance")).filter(F.col("donors") >= least)
    wide = weighted_quantile(near, [key], "_y", "_w", [0.1, 0.5, 0.9]).groupBy(key).agg(*(F.max(F.when(F.col("q") == q, F.col("_y"))).alias(n) for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))))
    return stats.join(wide, key)


def residual_gate(predicted: DataFrame, truth: DataFrame, key: str, target: str, group: list[str], median: float, p90: float, least: int = 10) -> DataFrame:
    """(group, pairs, median, p90, passes): whether the absolute residuals of a group stay within both limits."""
    r = predicted.join(truth.select(key, *group, target), key).withColumn("_r", F.abs(F.col("p50") - F.col(target)))
    s = r.groupBy(*group).agg(F.count("_r").alias("pairs"), F.percentile("_r", F.lit(0.5)).alias("median"), F.percentile("_r", F.lit(0.9)).alias("p90"))
    return s.withColumn("passes", (F.col("pairs") >= least) & (F.col("median") <= median) & (F.col("p90") <= p90))


def fingerprint_distance(left: DataFrame, right: DataFrame, on: list[str], axes: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, axes, distance): differences of medians over pooled scales, weighted by the reliability of both
    sides. Each side has, per axis a: a, a_n, a_iqr, and left a_scale."""
    r = right.select(*on, F.col(right_id).alias("_id"), *(F.col(f"{a}{s}").alias(f"_{a}{s}") for a in axes for s in ("", "_n", "_iqr")))
    j = left.join(r, on)
    trust = lambda p, a: F.sqrt(F.greatest(F.col(f"{p}{a}_n"), F.lit(1)).cast("double")) / (1 + F.abs(F.coalesce(F.col(f"{p}{a}_iqr"), F.lit(0.0))))
    both = {a: F.col(a).isNotNull() & F.col(f"_{a}").isNotNull() for a in axes}
    weight: dict[str, Column] = {a: F.when(both[a], F.sqrt(trust("", a) * trust("_", a))).otherwise(0.0) for a in axes}
    term = {a: F.when(both[a], weight[a] * F.pow((F.col(f"_{a}") - F.col(a)) / F.col(f"{a}_scale"), 2)).otherwise(0.0) for a in axes}
    zero = F.lit(0.0)
    return j.select(left_id, F.col("_id").alias(right_id), sum((b.cast("int") for b in both.values()), F.lit(0)).alias("axes"), F.sqrt(F.try_divide(sum(term.values(), zero), F.nullif(sum(weight.values(), zero), F.lit(0.0)))).alias("distance"))
