"""Brackets between what was survived and what destroyed, parameter grids, and chart queries.

Defined results: rows without a value or outcome count for neither side; a bracket is usable only with both sides known
often enough; inverted brackets are ordered and marked; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ohmgrid.operators import near
from ohmgrid.operators.statistics import mode


def bracket(df: DataFrame, key: list[str], basis: str, value: str, failed: str, least: int = 3) -> DataFrame:
    """(key, basis, survived, destroyed, low, high, inverted, usable) over the most frequent basis of each key."""
    own = df.filter(f"{value} > 0 AND {failed} IS NOT NULL")
    pick = mode(own, key, basis).drop("n")
    g = own.join(pick, [*key, basis]).groupBy(*key, basis)
    a = g.agg(F.count_if(~F.col(failed)).alias("survived"), F.count_if(F.col(failed)).alias("destroyed"), F.max(F.when(~F.col(failed), F.col(value))).alias("_s"), F.min(F.when(F.col(failed), F.col(value))).alias("_d"))
    both = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    return a.select(
        *key, basis, "survived", "destroyed", F.when(both, F.least("_s", "_d")).alias("low"), F.when(both, F.greatest("_s", "_d")).alias("high"), (F.col("_s") > F.col("_d")).alias("inverted"),
        (both & (F.col("survived") >= least) & (F.col("destroyed") >= least)).alias("usable"),
    )


def with_fallback(bounds: DataFrame, wider: DataFrame, key: list[str], wide_key: list[str]) -> DataFrame:
    """bounds, the unusable ones replaced by the usable ones of their wider key, and where each comes from."""
    w = wider.filter("usable").select(*wide_key, F.col("low").alias("_low"), F.col("high").alias("_high"))
    j = bounds.join(w, wide_key, "left")
    own = F.col("usable")
    return j.select(*dict.fromkeys([*key, *wide_key]), F.when(own, F.col("low")).otherwise(F.col("_low")).alias("low"), F.when(own, F.col("high")).otherwise(F.col("_high")).alias("high"), F.when(own, "own").when(F.col("_low").isNotNull(), "wider").otherwise("none").alias("source"))


def axis_distance(pairs: DataFrame, axes: dict[str, tuple[str, str]], scales: dict[str, float | Column]) -> DataFrame:
    """pairs plus axes_used and distance: root mean square of the scaled differences of the axes that both sides have."""
    part = {a: (F.col(x) - F.col(y)) / scales[a] for a, (x, y) in axes.items()}
    used = sum((v.isNotNull().cast("int") for v in part.values()), F.lit(0))
    total = sum((F.coalesce(v * v, F.lit(0.0)) for v in part.values()), F.lit(0.0))  # pow costs several times as much
    return pairs.withColumn("axes_used", used).withColumn("distance", F.when(used > 0, F.sqrt(total / used)))


def rounded(c: str, digits: int) -> Column:
    """A column of doubles from 0 up, rounded in binary as SQL engines do, without the decimal text that round() goes through."""
    scale = 10.0**digits
    z = F.col(c) * scale  # from 2**52 on it is whole
    return F.when(z < 2.0**52, F.floor(z + 0.5) / scale).when(z < float("inf"), z / scale).otherwise(F.col(c))


def best_candidates(targets: DataFrame, candidates: DataFrame, on: list[str], axes: list[tuple[str, str]], target: str, candidate: str, scores: list[Callable], digits: int = 9, shown: int | None = None) -> DataFrame:
    """(place, target, candidate, score): the candidate of the same key of lowest score for each target, under each of the
    scores, whose place in the list is named. Scores are as in near.best_match, NaN for none; those equal to so many digits
    tie, the lower candidate first; shown rounds them. The first axis is searched in order, the others should have few values."""
    value = lambda cols: [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]
    a = targets.select(*on, target, *value(x for x, _ in axes))
    b = candidates.select(*on, F.col(candidate).alias("_id"), *value(y for _, y in axes)).filter("_id IS NOT NULL")
    types = (("place", IntegerType()), (target, a.schema[target].dataType), (candidate, b.schema["_id"].dataType), ("score", DoubleType()))

    def best_rows(one, other):
        x, y = ([near.column(t, f"_{i}") for i in range(len(axes))] for t in (one, other))
        ids, out = near.ranked(other, "_id"), []
        with np.errstate(all="ignore"):
            for k, f in enumerate(scores):
                at = near.best_match(x, y, ids, lambda p, q: near.half_up(f(p, q), digits))[0]  # noqa: B023
                s = f(x, [(v[at], known[at]) for v, known in y])
                s = s if shown is None else near.half_up(s, shown)
                out.append([pa.repeat(pa.scalar(k, pa.int32()), len(at)), one.column(target).combine_chunks(), other.column("_id").take(at).combine_chunks(), pa.array(s, mask=np.isnan(s))])
        return [pa.chunked_array(c) for c in zip(*out)]

    return near.by_key(a, b, on, target, best_rows, StructType([StructField(n, t) for n, t in types]))


def grid_best(targets: DataFrame, candidates: DataFrame, on: list[str], settings: DataFrame, axes: dict[str, tuple[str, str]], target: str, candidate: str, shown: int | None = None) -> DataFrame:
    """(setting, target, candidate, distance): the best candidate of the same key of each target under each row of settings,
    a small table of one scale column for each axis; distance as in axis_distance."""
    rows = [r.asDict() for r in settings.collect()]  # the grid

    def distance(r):
        def score(x, y):
            both = [p & q for (_, p), (_, q) in zip(x, y)]
            total = sum(np.where(k, ((v - w) / r[f"scale_{a}"]) ** 2, 0.0) for a, k, (v, _), (w, _) in zip(axes, both, x, y))
            return np.sqrt(total / sum(both))  # NaN without a shared axis

        return score

    got = best_candidates(targets, candidates, on, list(axes.values()), target, candidate, [distance(r) for r in rows], shown=shown)
    setting = F.element_at(F.array(*(F.lit(r["setting"]).cast(settings.schema["setting"].dataType) for r in rows)), F.col("place") + 1)
    return got.select(setting.alias("setting"), target, candidate, F.col("score").alias("distance"))


def chart_query(df: DataFrame, x: list[str], metrics: dict[str, str], series: list[str] | None = None, where: str | None = None, limit: int | None = None, series_limit: int | None = None, series_metric: str = "count(*)") -> DataFrame:
    """What a chart asks: filtered rows grouped by x and series with metrics (SQL aggregates); of the series only the first
    series_limit by series_metric; limit is the chart's own row limit."""
    out = df.filter(where) if where else df
    series = series or []
    if series and series_limit:
        top = out.groupBy(*series).agg(F.expr(series_metric).alias("_m")).orderBy(F.desc_nulls_last("_m"), *series).limit(series_limit)
        out = out.join(F.broadcast(top.select(*series)), series, "left_semi")
    got = out.groupBy(*x, *series).agg(*(F.expr(e).alias(n) for n, e in metrics.items()))
    return got.orderBy(*x, *series).limit(limit) if limit else got


def cumulative_shares(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, share): the empirical distribution, one row a distinct value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("share", F.sum("_c").over(w) / F.sum("_c").over(Window.partitionBy(*key))).drop("_c")


def agreement(picks: DataFrame, target: str, method: str, pick: str) -> DataFrame:
    """(method_a, method_b, targets, agree): how often two methods pick the same for a target."""
    a = picks.select(target, F.col(method).alias("method_a"), F.col(pick).alias("_a"))
    b = picks.select(target, F.col(method).alias("method_b"), F.col(pick).alias("_b"))
    j = a.join(b, target).filter("method_a < method_b")
    return j.groupBy("method_a", "method_b").agg(F.count("*").alias("targets"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("agree"))
