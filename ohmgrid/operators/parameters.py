"""Device parameters out of sweeps, and gates of new values against a population.

Each parameter is one aggregation over the binned points of a file, joined to a second for its slice; everything runs per
file in partial aggregates. Ties (two slices equally near zero, two points equally near a target) go to the lower value.

Defined results: a file without the points that a parameter needs has no row for it; null or overflowed readings are left
out; repeated rows weigh in their bin's average; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.operators.cleaning import below_compliance, cleaned, half_up


def binned(points: DataFrame, files: DataFrame) -> DataFrame:
    """Average current of each (file, gate bin, drain bin), clamped points left out."""
    f = files.select(F.col("id").alias("metadata_id"), "measurement_category", "drain_bias_value")
    p = below_compliance(cleaned(points)).join(f, "metadata_id")
    swept = F.col("measurement_category").isin("IdVg", "Vth") & F.col("drain_bias_value").isNotNull()
    drain = F.when(swept, half_up("drain_bias_value", 2)).otherwise(half_up("v_drain", 2))
    keyed = p.select("metadata_id", "measurement_category", half_up("v_gate", 2).alias("vg"), drain.alias("vd"), "i_drain")
    return keyed.groupBy("metadata_id", "measurement_category", "vg", "vd").agg(F.avg("i_drain").alias("i"), F.avg(F.abs("i_drain")).alias("abs_i"))


def vth(bins: DataFrame, floor: float = 0.005, share: float = 0.01) -> DataFrame:
    """(metadata_id, vth_v, vth_vds): the lowest gate bin whose current reaches the threshold, on the slice nearest 0 V."""
    own = bins.filter("measurement_category IN ('Vth', 'IdVg') AND i > 0")
    peak = own.groupBy("metadata_id").agg(F.greatest(F.lit(floor), F.max("i") * share).alias("least"))
    cross = own.join(peak, "metadata_id").filter("i >= least").groupBy("metadata_id", "vd").agg(F.min("vg").alias("v"))
    near = F.struct(F.abs("vd").alias("a"), "vd", "v")
    return cross.filter("vd IS NOT NULL").groupBy("metadata_id").agg(F.min(near).alias("m")).select("metadata_id", F.col("m.v").alias("vth_v"), F.col("m.vd").alias("vth_vds"))


def rdson(bins: DataFrame, window: float = 1.0, share: float = 0.15, most: float = 2.0) -> DataFrame:
    """(metadata_id, rdson_mohm): least squares through the origin over the low drain voltages at the highest gate bias."""
    own = bins.filter("measurement_category = 'IdVd' AND i > 0")
    top = own.groupBy("metadata_id").agg(F.max("vg").alias("top_vg"), F.max("vd").alias("top_vd"))
    low = own.join(top, "metadata_id").filter((F.col("vg") >= F.col("top_vg") - window) & (F.col("vd") > 0) & (F.col("vd") <= F.least(F.col("top_vd") * share, F.lit(most))))
    return low.groupBy("metadata_id").agg((F.try_divide(F.sum(F.col("vd") * F.col("vd")), F.sum(F.col("vd") * F.col("i"))) * 1000).alias("rdson_mohm"))


def bvdss(bins: DataFrame, current: float = 100e-6) -> DataFrame:
    """(metadata_id, bvdss_v, crossed): the first drain bin at the current, else (anti-join) the highest one held."""
    own = bins.filter("measurement_category = 'Blocking' AND vg BETWEEN -1.0 AND 1.0")
    crossed = own.filter(F.col("abs_i") >= current).groupBy("metadata_id").agg(F.min("vd").alias("bvdss_v")).withColumn("crossed", F.lit(True))
    held = own.join(crossed.select("metadata_id"), "metadata_id", "left_anti").groupBy("metadata_id").agg(F.max("vd").alias("bvdss_v")).withColumn("crossed", F.lit(False))
    return crossed.unionByName(held)


def vsd(bins: DataFrame, category: str = "3rd_Quadrant", window: float = 0.5, least: float = 0.010) -> DataFrame:
    """(metadata_id, vsd_v): the drain voltage where the reverse current is nearest a tenth of its peak, at the least
    negative gate bias that conducts."""
    own = bins.filter((F.col("measurement_category") == category) & (F.col("i") < 0))
    anchor = own.groupBy("metadata_id").agg(F.max("vg").alias("anchor"))
    piece = own.join(anchor, "metadata_id").filter(F.abs(F.col("vg") - F.col("anchor")) <= window)
    target = piece.groupBy("metadata_id").agg((F.min("i") * 0.1).alias("target"), F.min("i").alias("peak")).filter(F.abs("peak") >= least)
    near = F.struct(F.abs(F.col("i") - F.col("target")).alias("off"), F.abs("vd").alias("v"))
    return piece.join(target, "metadata_id").groupBy("metadata_id").agg(F.min(near).alias("m")).select("metadata_id", F.col("m.v").alias("vsd_v"))


def sweep_extent(points: DataFrame) -> DataFrame:
    """(metadata_id, extremes of v_drain, i_drain and v_gate, points): what a sweep covered."""
    p = cleaned(points)
    return p.groupBy("metadata_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("v_drain", "i_drain", "v_gate") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("points"))


def refined_category(extent: DataFrame, files: DataFrame) -> DataFrame:
    """(metadata_id, measurement_category, refined): IdVd files that in truth block (30 V or more at less than 1 A) or else
    conduct in the third quadrant (at most 0.5 V, below -0.1 V, and below -0.1 uA)."""
    j = extent.join(files.select(F.col("id").alias("metadata_id"), "measurement_category"), "metadata_id")
    most = F.greatest(F.abs("min_i_drain"), F.abs("max_i_drain"))
    blocks = (F.col("max_v_drain") >= 30.0) & (most.isNull() | (most < 1.0))
    third = (F.col("max_v_drain") <= 0.5) & (F.col("min_v_drain") < -0.1) & (F.col("min_i_drain") < -1e-7)
    kind = F.when(F.col("measurement_category") == "IdVd", F.when(blocks, "Blocking").when(third, "3rd_Quadrant").otherwise("IdVd")).otherwise(F.col("measurement_category"))
    return j.select("metadata_id", "measurement_category", kind.alias("refined"))


def population_gate(values: DataFrame, group: str, value: str, k: float = 3.0, least: int = 3) -> DataFrame:
    """values with the group's median and interquartile range and a decision: inside median +- k IQR, outside, or too few."""
    stats = values.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.expr(f"percentile({value}, 0.5)").alias("median"), (F.expr(f"percentile({value}, 0.75)") - F.expr(f"percentile({value}, 0.25)")).alias("iqr")
    )
    decision = (
        F.when(F.col(value).isNull(), "no value").when(F.coalesce("n", F.lit(0)) < least, "too few").when(F.abs(F.col(value) - F.col("median")) <= k * F.col("iqr"), "inside").otherwise("outside")
    )
    return values.join(stats, group, "left").withColumn("decision", decision)


def flag_devices(values: DataFrame, group: str, owner: str, value: str, k: float = 3.0) -> DataFrame:
    """values whose owner has any value that is negative or k IQR below the group's median: one flags them all."""
    gated = population_gate(values, group, value, k, 1)
    low = (F.col(value) < 0) | (F.col(value) < F.col("median") - k * F.col("iqr"))
    return gated.withColumn("flagged", F.coalesce(F.bool_or(low).over(Window.partitionBy(group, owner)), F.lit(False)))
