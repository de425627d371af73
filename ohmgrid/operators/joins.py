"""Join shapes beyond the plain ones: best match per row, ordered rules, intervals, neighbours, key fallbacks.

Every one keeps an equality key, so it shuffles or broadcasts like any equi-join; none pairs all rows with all rows.

Defined results: null keys match nothing unless the null-safe form is asked for; ties are broken by the given last
column; left forms keep rows without a match; empty sides give empty (or left) results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ohmgrid.operators import near


def top_one(left: DataFrame, right: DataFrame, on: list[str], row: list[str], order: list[Column], condition: Column | None = None) -> DataFrame:
    """Each left row (named by the columns row) with its best right row by order, nulls where there is none."""
    j = left.join(right, on, "left")
    if condition is not None:
        fits = j.filter(condition)
        none = left.join(fits.select(*row).distinct(), row, "left_anti")
        j = fits.unionByName(none, allowMissingColumns=True)
    return j.withColumn("_n", F.row_number().over(Window.partitionBy(*row).orderBy(*order))).filter("_n = 1").drop("_n")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys of which nulls are equal; right's other columns are kept."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    keys = [left[c].eqNullSafe(r[f"_r_{c}"]) for c in on]
    return left.join(r, keys, how).drop(*(f"_r_{c}" for c in on))


def by_discriminator(left: DataFrame, right: DataFrame, kind: str, keys: dict[str, str], how: str = "left") -> DataFrame:
    """An OR of joins, one for each value of the column kind, as one equi-join: keys names the key column of each kind."""
    match = F.lit(None).cast("string")
    for value, key in keys.items():
        match = F.when(F.col(kind) == value, F.concat_ws("|", F.lit(value), F.col(key).cast("string"))).otherwise(match)
    return left.withColumn("match_key", match).join(right.withColumnRenamed("key", "match_key"), "match_key", how)


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], position: str, low: str = "first", high: str = "last", width: float | None = None) -> DataFrame:
    """Points with the intervals of the same key that hold their position.

    With width, positions are bucketed and each interval is repeated for the buckets it touches, so that a hot key is
    joined bucket by bucket instead of every point with every interval.
    """
    r = intervals.withColumnsRenamed({c: f"_r_{c}" for c in on})
    keys = [F.col(c) == F.col(f"_r_{c}") for c in on]
    p = points
    if width:
        bucket = lambda c: F.floor(c / width)
        p = points.withColumn("_bucket", bucket(F.col(position)))
        r = r.filter(F.col(low) <= F.col(high)).withColumn("_r_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
        keys.append(F.col("_bucket") == F.col("_r_bucket"))
    held = p.join(r, [*keys, F.col(position).between(F.col(low), F.col(high))])
    return held.drop(*(f"_r_{c}" for c in on), "_bucket", "_r_bucket")


def nearest(left: DataFrame, right: DataFrame, on: list[str], features: list[str], scales: dict[str, float], left_id: str, right_id: str, k: int, digits: int = 9) -> DataFrame:
    """The k right rows nearest each left row of the same key, by root mean square of scaled differences over the features
    that both have: (left_id, right_id, distance, shared, rank). Distances equal to so many digits tie, the lower id first.
    With one feature the rows are found in sorted order; with more, each left row meets every right row of its key."""
    if len(features) == 1:
        return _nearest_on_line(left, right, on, features[0], scales[features[0]], left_id, right_id, k, digits)
    r = right.select(*on, F.col(right_id).alias("_id"), *(F.col(f).alias(f"_{f}") for f in features))
    term = {f: F.pow((F.col(f) - F.col(f"_{f}")) / scales[f], 2) for f in features}
    shared = sum((t.isNotNull().cast("int") for t in term.values()), F.lit(0))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in term.values()), F.lit(0.0))
    j = left.select(*on, left_id, *features).join(r, on).withColumn("shared", shared).filter("shared > 0")
    j = j.withColumn("distance", F.sqrt(total / F.col("shared")))
    w = Window.partitionBy(left_id).orderBy(F.round("distance", digits), "_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(left_id, F.col("_id").alias(right_id), "distance", "shared", "rank")


def _nearest_on_line(left: DataFrame, right: DataFrame, on: list[str], feature: str, scale: float, left_id: str, right_id: str, k: int, digits: int) -> DataFrame:
    a = left.select(*on, left_id, F.col(feature).cast("double").alias("_x")).filter("_x IS NOT NULL")
    b = right.select(*on, F.col(right_id).alias("_id"), F.col(feature).cast("double").alias("_y")).filter("_y IS NOT NULL AND _id IS NOT NULL")
    schema = StructType([StructField(left_id, a.schema[left_id].dataType), StructField(right_id, b.schema["_id"].dataType), *(StructField(c, t) for c, t in (("distance", DoubleType()), ("shared", IntegerType()), ("rank", IntegerType())))])

    def near_rows(one, other):
        (x, _), (y, _) = near.column(one, "_x"), near.column(other, "_y")
        with np.errstate(all="ignore"):
            distance = lambda i, j: np.abs(x[i] - y[j]) / scale
            found = near.k_nearest(x, y, near.ranked(other, "_id"), k, lambda i, j: near.half_up(distance(i, j), digits))
            row, nth = np.nonzero(found >= 0)
            at = found[row, nth]
            return [one.column(left_id).take(row), other.column("_id").take(at), distance(row, at), np.ones(len(row), np.int32), (nth + 1).astype(np.int32)]

    return near.by_key(a, b, on, left_id, near_rows, schema)


def fallback(left: DataFrame, right: DataFrame, keys: list[list[str]], value: str, how_label: str = "matched_by") -> DataFrame:
    """left with value from right by the first key list that finds one, and by which; right keeps the lowest value a key."""
    out, found, label = left, F.lit(None).cast(right.schema[value].dataType), F.lit(None).cast("string")
    for i, on in enumerate(keys):
        r = right.groupBy(*on).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(r, on, "left")
    for i, on in reversed(list(enumerate(keys))):
        found = F.coalesce(F.col(f"_v{i}"), found)
        label = F.when(F.col(f"_v{i}").isNotNull(), "+".join(on)).otherwise(label)
    return out.withColumn(value, found).withColumn(how_label, label).drop(*(f"_v{i}" for i in range(len(keys))))


def by_rules(rows: DataFrame, rules: DataFrame, text: str, scope: str, result: str) -> DataFrame:
    """rows with the result of the first rule that fits: of the row's scope or `all`, by substring or regular expression,
    highest priority first, then longest pattern, then lowest id. Rules meet a row by their scope, as one array."""
    rule = F.struct((-F.col("priority")).alias("p"), (-F.length("pattern")).alias("l"), "id", "pattern_type", "pattern", F.col(result).alias("result"))
    sets = rules.filter("pattern <> '' AND priority IS NOT NULL").groupBy(F.col("scope").alias("_scope")).agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    texts = rows.select(text, scope).filter(F.col(text).isNotNull()).distinct()
    tried = texts.withColumn("_scope", F.explode(F.array_distinct(F.array(F.lit("all"), F.coalesce(scope, F.lit("all")))))).join(sets, "_scope")
    fits = lambda x: F.when(x["pattern_type"] == "substring", F.contains(F.upper(text), F.upper(x["pattern"]))).otherwise(F.rlike(F.col(text), F.concat(F.lit("(?i)"), x["pattern"])))
    hit = tried.withColumn("_hit", F.get(F.filter("_rules", fits), F.lit(0))).filter("_hit IS NOT NULL")
    best = hit.groupBy(text, scope).agg(F.min(F.struct("_hit.p", "_hit.l", "_hit.id", "_hit.result")).alias("_b")).select(text, scope, F.col("_b.result").alias(result))
    return null_safe(rows, best, [text, scope], "left")
