"""Window operators over the ordered points of one file: lags, islands, rolling medians, integrals and crossings.

The order is (order columns nulls last), with an index as last key so that equal times have one order. Every operator
takes the key and order columns; nothing is collected into arrays but small fixed frames.

Defined results: null values give null steps and break nothing else; groups of one row have no steps; empty tables give
empty results; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.session import materialize

#: Rows of a key that one task looks back over.
BLOCK = 65_536


def ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*(F.asc_nulls_last(o) for o in order))


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "position") -> DataFrame:
    """df plus name: the number of each row within its key, from 1, by order (nulls last).

    A key may hold any part of all rows: rows are range-partitioned by key and order, numbered inside their partition, and
    moved on by the rows of their key in the partitions before, of which there is one row for each key and partition.
    """
    by = [*key, *(x for i, o in enumerate(order) for x in (f"_null{i}", o))]
    d = df.withColumns({f"_null{i}": F.col(o).isNull() for i, o in enumerate(order)})
    d = d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_i", F.monotonically_increasing_id()).drop(*(f"_null{i}" for i in range(len(order))))
    d = materialize(d, "numbered").withColumn("_part", F.shiftright("_i", 33))
    runs = d.groupBy(*key, "_part").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_move", before - F.col("_first") + 1).select(*(F.col(k).alias(f"_k_{k}") for k in key), F.col("_part").alias("_p"), "_move")
    on = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key)]
    return d.join(runs, on).withColumn(name, F.col("_i") + F.col("_move")).drop("_i", "_part", "_p", "_move", *(f"_k_{k}" for k in key))


def look_back(df: DataFrame, key: list[str], position: str, columns: dict[str, str], block: int = BLOCK) -> DataFrame:
    """df plus, for each new name of columns, the value of its column in the row before; position is dense within the key.

    lag() runs in blocks of positions; the first row of a block gets its values from the last row of the block before.
    """
    w = Window.partitionBy(*key, "_block").orderBy(position)
    d = df.withColumn("_block", F.floor(F.col(position) / block))
    d = d.withColumns({n: F.lag(c).over(w) for n, c in columns.items()}).drop("_block")
    at_edge = F.pmod(F.col(position), F.lit(block)) == 0
    last = df.filter(F.pmod(F.col(position) + 1, F.lit(block)) == 0).select(*key, (F.col(position) + 1).alias(position), *(F.col(c).alias(n) for n, c in columns.items()))
    edge = d.filter(at_edge).drop(*columns).join(last, [*key, position], "left").select(*d.columns)
    return d.filter(~at_edge).unionByName(edge)


def in_blocks(df: DataFrame, position: str, margin: int, block: int = BLOCK) -> DataFrame:
    """df with _block and _core: every row in its block of positions and, within margin of an edge, also in the block
    beside it (there _core is false), so that a window of up to margin rows either way runs inside one block."""
    own = F.floor(F.col(position) / block)
    off = F.pmod(F.col(position), F.lit(block))
    at = lambda b, core: F.struct(b.alias("_block"), F.lit(core).alias("_core"))
    places = F.array_compact(F.array(at(own, True), F.when(off < margin, at(own - 1, False)), F.when(off >= block - margin, at(own + 1, False))))
    return df.select("*", F.inline(places))


def islands(df: DataFrame, key: list[str], position: str, gap: int | float) -> DataFrame:
    """df plus island: a number that goes up where position is more than gap beyond the one before it."""
    w = ordered(key, [position])
    new = F.when(F.col(position) - F.lag(position).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def clusters(df: DataFrame, key: list[str], position: str, gap: int | float) -> DataFrame:
    """(key, island, first, last, n): the clusters of positions that are no more than gap apart."""
    return islands(df, key, position, gap).groupBy(*key, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))


def trapezoid(df: DataFrame, key: list[str], order: list[str], time: str, value: Column | str) -> DataFrame:
    """(key, integral, duration, steps) of value over time; a segment needs both ends."""
    w = ordered(key, order)
    v = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_v", v)
    dt = F.greatest(F.col(time) - F.lag(time).over(w), F.lit(0.0))
    d = d.withColumn("_dt", dt).withColumn("_seg", (F.col("_v") + F.lag("_v").over(w)) / 2 * F.col("_dt"))
    return d.groupBy(*key).agg(F.sum("_seg").alias("integral"), F.sum(F.when(F.col("_seg").isNotNull(), F.col("_dt"))).alias("duration"), F.count("_seg").alias("steps"))


def time_at_or_above(df: DataFrame, key: list[str], order: list[str], time: str, value: str, share: float = 0.5) -> DataFrame:
    """(key, peak, duration): the time spent at share of the key's own peak or more."""
    w = ordered(key, order)
    peak = F.max(F.abs(value)).over(Window.partitionBy(*key))
    dt = F.greatest(F.col(time) - F.lag(time).over(w), F.lit(0.0))
    d = df.withColumn("_peak", peak).withColumn("_dt", dt)
    return d.groupBy(*key).agg(F.max("_peak").alias("peak"), F.sum(F.when(F.abs(value) >= share * F.col("_peak"), F.col("_dt"))).alias("duration"))


def rolling_step(df: DataFrame, key: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """df plus before, after (medians of width values on either side, own value after) and step, their non-negative rise."""
    w = ordered(key, order)

    def median(frame) -> Column:
        a = F.array_sort(F.collect_list(value).over(frame))  # at most width values
        n = F.size(a)
        return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)

    before, after = median(w.rowsBetween(-width, -1)), median(w.rowsBetween(0, width - 1))
    return df.withColumn("before", before).withColumn("after", after).withColumn("step", F.coalesce(F.greatest(F.col("after") - F.col("before"), F.lit(0.0)), F.lit(0.0)))


def edge_medians(df: DataFrame, key: list[str], order: list[str], value: str, width: int = 5) -> DataFrame:
    """(key, head, tail): medians of the first and last width values."""
    w = ordered(key, order)
    back = Window.partitionBy(*key).orderBy(*(F.desc_nulls_first(o) for o in order))
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_j", F.row_number().over(back))
    part = lambda c: F.percentile(F.when(F.col(c) <= width, F.col(value)), F.lit(0.5))
    return d.groupBy(*key).agg(part("_i").alias("head"), part("_j").alias("tail"))


def first_crossing(df: DataFrame, key: list[str], position: str, condition: Column) -> DataFrame:
    """(key, crossing): the lowest position where the condition holds, null where it never does."""
    return df.groupBy(*key).agg(F.min(F.when(condition, F.col(position))).alias("crossing"))


def running_total(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """df plus ordinal and total: the running sum, null from the first null value on."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.col(value).isNull().cast("int")).over(w)
    return df.withColumn("ordinal", F.count(F.lit(1)).over(w)).withColumn("total", F.when(broken == 0, F.sum(value).over(w)))


def first_last(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, first, last) of the non-null values; rows with null order keys come last."""
    place = F.struct(*(x for o in order for x in (F.col(o).isNull().alias(f"n_{o}"), F.col(o))))
    d = df.filter(F.col(value).isNotNull()).withColumn("_p", place)
    return d.groupBy(*key).agg(F.min_by(value, "_p").alias("first"), F.max_by(value, "_p").alias("last"))


def argmax(df: DataFrame, key: list[str], value: str, position: str) -> DataFrame:
    """(key, position, value) of the largest value, the lowest position of equals."""
    best = F.max_by(F.struct(position, value), F.struct(F.col(value), -F.col(position)))
    return df.filter(F.col(value).isNotNull()).groupBy(*key).agg(best.alias("b")).select(*key, f"b.{position}", f"b.{value}")
