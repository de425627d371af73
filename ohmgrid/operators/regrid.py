"""Irregular readings onto a regular grid: lead() pairs consecutive occupied slots and only the slots between them are made.

slot = floor(time_val / delay_time) of the file. Readings of one slot are folded first (first and last reading by time),
so each file has at most one row per slot. lead() runs inside spans of SPAN slots; the last row of a span gets the first
row of the next occupied span through a second lead() over one row per span. No task ever holds a whole hot file.

Defined results: a null, NaN or overflowed (1e30 or more) time_val does not count; a file without positive delay_time has
no grid; null channels stay null and are interpolated only between two readings that have them; repeated rows fall into
one slot; ties of time in a slot are broken by the row's values; the grid starts at the first and ends at the last
occupied slot of the file, or is extended to given bounds by marked slots without values (bounds inside the readings
extend nothing, a null bound extends nothing on its side, and a file without a reading is not extended); empty tables give an empty grid; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.session import join_dimension, materialize

CHANNELS = ("v_gate", "i_gate", "v_drain", "i_drain")
LIMIT = 1e30
#: A stretch of more missing slots than this is a pause: marked, never filled.
PAUSE = 100
SPAN = 4096
#: Slots made from one row at most; longer pauses are first cut into pieces of this many.
PIECE = 10_000


def _valid(c: Column) -> Column:
    return F.when((F.abs(c) < LIMIT) & ~F.isnan(c), c)


def occupied_slots(points: DataFrame, files: DataFrame, channels: tuple[str, ...] = ()) -> DataFrame:
    """One row (metadata_id, slot) per occupied slot, with the first and last time and reading of each channel in it."""
    grid = files.filter("delay_time > 0 AND NOT isnan(delay_time)").select(F.col("id").alias("metadata_id"), "delay_time")
    t = F.col("time_val")
    timed = points.select("metadata_id", "time_val", *channels).filter(t.isNotNull() & (F.abs(t) < LIMIT) & ~F.isnan(t))
    at = join_dimension(timed, grid, "metadata_id").withColumn("slot", F.floor(t / F.col("delay_time")))
    if not channels:
        return at.groupBy("metadata_id", "slot").agg(F.first("delay_time").alias("delay_time"))
    reading = F.struct("time_val", *(_valid(F.col(c)).alias(c) for c in channels))
    return at.groupBy("metadata_id", "slot").agg(F.first("delay_time").alias("delay_time"), F.min(reading).alias("first"), F.max(reading).alias("last"))


def paired_slots(slots: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """slots plus next_slot (and next_<c> for c in carry): the following occupied slot of the file, null at its end."""
    own = slots.withColumn("span", F.floor(F.col("slot") / SPAN))
    w = Window.partitionBy("metadata_id", "span").orderBy("slot")
    nxt = F.struct("slot", *carry)
    inner = own.withColumn("nxt", F.lead(nxt).over(w))
    over = Window.partitionBy("metadata_id").orderBy("span")
    starts = own.groupBy("metadata_id", "span").agg(F.min_by(nxt, "slot").alias("head")).withColumn("after", F.lead("head").over(over)).select("metadata_id", "span", "after")
    out = inner.filter("nxt IS NOT NULL").unionByName(
        inner.filter("nxt IS NULL").drop("nxt").join(starts, ["metadata_id", "span"]).withColumnRenamed("after", "nxt")
    )
    return out.select(*slots.columns, F.col("nxt.slot").alias("next_slot"), *(F.col(f"nxt.{c}").alias(f"next_{c}") for c in carry))


def missing_slots(points: DataFrame, files: DataFrame) -> DataFrame:
    """(metadata_id, slot): the empty slots between two readings of a file that are no more than PAUSE apart."""
    pairs = paired_slots(materialize(occupied_slots(points, files), "slots"))
    gap = F.col("next_slot") - F.col("slot") - 1
    return pairs.filter((gap >= 1) & (gap <= PAUSE)).select("metadata_id", F.explode(F.sequence(F.col("slot") + 1, F.col("next_slot") - 1)).alias("slot"))


def regular_series(points: DataFrame, files: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """The whole grid: (metadata_id, slot, grid_time, status, channels), status `read`, `filled` or `pause`, and with bounds
    (metadata_id, first_slot, last_slot) also `before` and `after` the readings.

    A read slot has the last valid state of its last reading; a filled one the straight line from the last reading before
    to the first after, at the slot's begin; a pause has nulls.
    """
    slots = materialize(occupied_slots(points, files, CHANNELS), "slots")
    pairs = paired_slots(slots, ("first",))
    time = lambda s: F.col("delay_time") * s
    read = slots.select("metadata_id", "slot", time(F.col("slot")).alias("grid_time"), F.lit("read").alias("status"), *(F.col(f"last.{c}").alias(c) for c in CHANNELS))
    gap = F.col("next_slot") - F.col("slot") - 1
    pieces = pairs.filter(gap >= 1).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((gap - 1) / PIECE))))
    low = F.col("slot") + 1 + F.col("piece") * PIECE
    made = pieces.withColumn("s", F.explode(F.sequence(low, F.least(low + PIECE - 1, F.col("next_slot") - 1))))
    fill = gap <= PAUSE
    w = (time(F.col("s")) - F.col("last.time_val")) / (F.col("next_first.time_val") - F.col("last.time_val"))
    line = [F.when(fill, F.col(f"last.{c}") + w * (F.col(f"next_first.{c}") - F.col(f"last.{c}"))).alias(c) for c in CHANNELS]
    grid = read.unionByName(
        made.select("metadata_id", F.col("s").alias("slot"), time(F.col("s")).alias("grid_time"), F.when(fill, "filled").otherwise("pause").alias("status"), *line)
    )
    return grid if bounds is None else grid.unionByName(_extended(slots, bounds))


def _extended(slots: DataFrame, bounds: DataFrame) -> DataFrame:
    """The slots between each file's bounds and its first and last occupied slot, PIECE at most from one row."""
    edges = slots.groupBy("metadata_id").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.first("delay_time").alias("delay_time"))
    j = join_dimension(edges, bounds.select("metadata_id", F.col("first_slot").cast("long").alias("first_slot"), F.col("last_slot").cast("long").alias("last_slot")), "metadata_id")
    side = lambda name, a, b: F.when(a <= b, F.struct(F.lit(name).alias("status"), a.alias("a"), b.alias("b")))
    sides = F.array_compact(F.array(side("before", F.col("first_slot"), F.col("low") - 1), side("after", F.col("high") + 1, F.col("last_slot"))))
    e = j.select("metadata_id", "delay_time", F.inline(sides)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / PIECE))))
    low = F.col("a") + F.col("piece") * PIECE
    e = e.withColumn("slot", F.explode(F.sequence(low, F.least(low + PIECE - 1, F.col("b")))))
    return e.select("metadata_id", "slot", (F.col("delay_time") * F.col("slot")).alias("grid_time"), "status", *(F.lit(None).cast("double").alias(c) for c in CHANNELS))
