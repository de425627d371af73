"""Single events in time series of currents: robust thresholds, clusters, context, classes, and energy windows.

A file's points are numbered by (time, index) over any number of tasks; differences look back in blocks; events are
aggregates of clusters joined back, bucket by bucket, to the points around them. The class is one ladder over ratios of the steps.

Defined results: overflowed and null readings have no difference; a file of fewer than six points has sigma 0 and so the
floor as threshold; a file without candidates has no event; ties of a peak go to the lowest position; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.operators.cleaning import cleaned
from ohmgrid.operators.joins import points_in_intervals
from ohmgrid.operators.series import in_blocks, islands, look_back, numbered
from ohmgrid.operators.statistics import robust_sigma
from ohmgrid.session import materialize


#: Readings of this size are overflow marks, not measurements.
LIMIT = 1e30


@dataclass(frozen=True)
class Detector:
    """Fixed values of the detector: thresholds in A, points, and ratio bands."""

    sigmas: float = 8.0
    drain_floor: float = 1e-6
    gate_floor: float = 1e-8
    weak_drain: float = 0.25
    ramp: int = 3
    gap: int = 2
    context: int = 4
    coupled: tuple[float, float] = (0.33, 3.0)
    source: float = 10.0


def positioned(points: DataFrame) -> DataFrame:
    """(metadata_id, position, time_val, channels): distinct cleaned points numbered by (time, point_index)."""
    p = cleaned(points).select("metadata_id", "point_index", "time_val", "v_gate", "i_gate", "v_drain", "i_drain", "fluence").distinct()
    return numbered(p, ["metadata_id"], ["time_val", "point_index"])


def _median(values: list[Column]) -> Column:
    """Median of the values that are not null; null without any."""
    x = F.array_sort(F.array_compact(F.array(*values)))
    n = F.size(x)
    return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2


def signals(pos: DataFrame, cfg: Detector = Detector()) -> DataFrame:
    """(metadata_id, position, d_drain, d_gate, s_drain, s_gate): by how much each current rose since the point before,
    and the larger of that and of the ramp, the median of the next cfg.ramp points (its own included) less that of the
    cfg.ramp points before."""
    w = Window.partitionBy("metadata_id", "_block").orderBy("position")
    p = in_blocks(pos.select("metadata_id", "position", F.abs("i_drain").alias("drain"), F.abs("i_gate").alias("gate")), "position", cfg.ramp)
    cols = {}
    for c in ("drain", "gate"):
        step = F.col(c) - F.lag(c).over(w)
        ramp = _median([F.lead(c, k).over(w) for k in range(cfg.ramp)]) - _median([F.lag(c, k).over(w) for k in range(1, cfg.ramp + 1)])
        cols |= {f"d_{c}": step, f"s_{c}": F.greatest(F.lit(0.0), step, F.when(F.lag(F.lit(1)).over(w).isNotNull(), ramp))}
    return p.withColumns(cols).filter("_core").select("metadata_id", "position", *cols)


def candidates(pos: DataFrame, cfg: Detector = Detector()) -> DataFrame:
    """Positions whose rise of drain or gate current, in one step or as a ramp, reaches its file's threshold, with both
    rises and thresholds."""
    out = d = materialize(signals(pos, cfg), "steps")
    for c, floor in (("drain", cfg.drain_floor), ("gate", cfg.gate_floor)):
        s = robust_sigma(d, ["metadata_id"], f"d_{c}").select("metadata_id", F.greatest(F.lit(floor), cfg.sigmas * F.col("sigma")).alias(f"t_{c}"))
        out = out.join(s, "metadata_id", "left").withColumn(f"t_{c}", F.coalesce(f"t_{c}", F.lit(floor)))
    out = out.withColumn("d_drain", F.col("s_drain")).withColumn("d_gate", F.col("s_gate")).drop("s_drain", "s_gate")
    return out.filter((F.col("d_drain") >= F.col("t_drain")) | ((F.col("d_gate") >= F.col("t_gate")) & (F.col("d_drain") >= cfg.weak_drain * F.col("t_drain"))))


def events(pos: DataFrame, cfg: Detector = Detector()) -> DataFrame:
    """(metadata_id, event, first, last, peak, i_before, i_after, v_before, v_after, rises, ratio, kind)."""
    c = islands(candidates(pos, cfg), ["metadata_id"], "position", cfg.gap)
    e = c.groupBy("metadata_id", F.col("island").alias("event")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.max("d_drain").alias("rise_drain"), F.max("d_gate").alias("rise_gate"), F.max("t_drain").alias("t_drain"), F.max("t_gate").alias("t_gate")
    )
    reach = e.select("metadata_id", "event", "first", "last", (F.col("first") - cfg.context).alias("low"), (F.col("last") + cfg.context).alias("high"))
    around = points_in_intervals(pos, reach, ["metadata_id"], "position", "low", "high", width=256)
    before, after = F.col("position") < F.col("first"), F.col("position") > F.col("last")
    med = lambda cond, x: F.percentile(F.when(cond, F.col(x)), F.lit(0.5))
    level = F.abs("i_drain")
    peak = F.max_by("position", F.when(~before & ~after, F.struct(level, -F.col("position"))))
    ctx = around.groupBy("metadata_id", "event").agg(
        peak.alias("peak"), F.max(F.when(~before & ~after, level)).alias("i_peak"), med(before, "i_drain").alias("i_before"), med(after, "i_drain").alias("i_after"), med(before, "v_drain").alias("v_before"), med(after, "v_drain").alias("v_after")
    )
    out = e.join(ctx, ["metadata_id", "event"]).withColumn("ratio", F.try_divide("rise_drain", F.nullif(F.col("rise_gate"), F.lit(0.0))))
    return out.withColumn("kind", kind(cfg))


def kind(cfg: Detector = Detector()) -> Column:
    """The class of an event by which current rose: both alike, the drain alone, or between."""
    gate, drain = F.col("rise_gate") >= F.col("t_gate"), F.col("rise_drain") >= F.col("t_drain")
    r = F.col("ratio")
    return F.when(drain & ~gate, "drain_source").when(gate & r.between(*cfg.coupled), "drain_gate").when(gate & (r >= cfg.source), "drain_source").otherwise("mixed")


def collapse(event: DataFrame) -> DataFrame:
    """events plus collapse: the part of the drain voltage that was lost, 0 for a rise."""
    return event.withColumn("collapse", F.try_divide(F.greatest(F.col("v_before") - F.col("v_after"), F.lit(0.0)), F.nullif(F.abs("v_before"), F.lit(0.0))))


@dataclass(frozen=True)
class Windows:
    """Fixed values of active windows: what counts as a step of fluence, the part of the compliance that counts as
    reached, and the current that counts as failure where no compliance is known."""

    absolute: float = 1e-9
    relative: float = 1e-9
    span: float = 1.0
    share: float = 0.995
    failure: float = 1e-2


def active_window(pos: DataFrame, files: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """(metadata_id, basis, active_start, active_stop, start, stop, failure, reason, comparable) of each file.

    The beam is on from the point before the first step of fluence beyond the tolerance to the end of the last one; a fall
    of fluence leaves the energy window (start, stop) unknown. The current censors the window where it first reaches,
    inside it, the lower of the two compliances or, where none is known, the failure current.
    """
    seen = pos.filter("fluence IS NOT NULL AND NOT isnan(fluence) AND time_val IS NOT NULL").select("metadata_id", "time_val", "fluence", F.col("position").alias("place"))
    seen = look_back(numbered(seen, ["metadata_id"], ["place"]), ["metadata_id"], "position", {"b_time": "time_val", "b_fluence": "fluence"})
    most = seen.groupBy("metadata_id").agg(F.greatest(F.lit(cfg.absolute), cfg.relative * F.max(F.abs("fluence"))).alias("tolerance"))
    step = F.col("fluence") - F.col("b_fluence")
    rise, fall = step > F.col("tolerance"), step < -F.col("tolerance")
    beam = seen.join(most, "metadata_id").groupBy("metadata_id").agg(
        F.min(F.when(rise, F.col("b_time"))).alias("active_start"), F.max(F.when(rise, F.col("time_val"))).alias("active_stop"), F.bool_or(fall).alias("reset"),
        (F.max("fluence") - F.min("fluence")).alias("span"), F.count("*").alias("n"),
    )
    times = pos.groupBy("metadata_id").agg(F.count("time_val").alias("times"))
    lowest = F.least(*(F.when((F.abs(c) > 0) & (F.abs(c) < LIMIT), F.abs(c)) for c in ("compliance_ch1", "compliance_ch2")))
    limits = files.select(F.col("id").alias("metadata_id"), lowest.alias("compliance"))
    basis = (
        F.when(F.col("times") == 0, "unknown_no_time").when(F.coalesce("n", F.lit(0)) < 2, "unknown_no_fluence").when(F.coalesce("reset", F.lit(False)), "fluence_reset_artifact")
        .when(F.col("active_start").isNotNull() & (F.col("span") >= cfg.span), "fluence_positive_delta").otherwise("fluence_static_or_missing_progression")
    )
    w = times.join(beam, "metadata_id", "left").join(limits, "metadata_id", "left").withColumn("basis", basis)
    known = F.col("basis") == "fluence_positive_delta"
    shown = known | (F.col("basis") == "fluence_reset_artifact")
    w = w.withColumns({"start": F.when(known, F.col("active_start")), "stop": F.when(known, F.col("active_stop"))})
    w = w.withColumns({c: F.when(shown, F.col(c)) for c in ("active_start", "active_stop")}).withColumn("most", F.coalesce(F.col("compliance") * cfg.share, F.lit(cfg.failure)))
    w = materialize(w.select("metadata_id", "basis", "active_start", "active_stop", "start", "stop", "compliance", "most"), "windows")
    hit = pos.join(w.filter("start IS NOT NULL").select("metadata_id", "start", "stop", "most"), "metadata_id").filter("time_val BETWEEN start AND stop AND abs(i_drain) >= most")
    w = w.join(hit.groupBy("metadata_id").agg(F.min("time_val").alias("failure")), "metadata_id", "left")
    failed = F.col("failure").isNotNull()
    reason = (
        F.when(failed & F.col("compliance").isNotNull(), "current_compliance").when(failed, "heuristic_current_plateau").when(known, "none")
        .when(F.col("basis") == "fluence_reset_artifact", "fluence_reset_artifact").otherwise("active_window_unknown")
    )
    return w.select("metadata_id", "basis", "active_start", "active_stop", "start", F.coalesce("failure", "stop").alias("stop"), "failure", reason.alias("reason"), (known & ~failed).alias("comparable"))


def point_flags(pos: DataFrame, windows: DataFrame) -> DataFrame:
    """(metadata_id, position, active, before_failure, integrable, exclusion) of every point; exclusion is null for none."""
    j = pos.select("metadata_id", "position", "time_val").join(windows.select("metadata_id", "active_start", "active_stop", "start", "stop", "failure"), "metadata_id")
    t = F.col("time_val")
    active = F.coalesce(t.between(F.col("active_start"), F.col("active_stop")), F.lit(False))
    before = t.isNotNull() & F.coalesce(t <= F.col("failure"), F.lit(True))
    inside = F.coalesce(t.between(F.col("start"), F.col("stop")), F.lit(False)) & before
    why = (
        F.when(t.isNull(), "no_time").when(F.col("active_start").isNull(), "active_window_unknown").when(~active, "outside_active_window")
        .when(~before, "post_failure_or_compliance").when(F.col("start").isNull(), "energy_window_unknown")
    )
    return j.select("metadata_id", "position", active.alias("active"), before.alias("before_failure"), inside.alias("integrable"), why.alias("exclusion"))


def energy_in_windows(pos: DataFrame, windows: DataFrame) -> DataFrame:
    """(metadata_id, energy_j, absolute_j, steps): trapezoids of drain power between points inside their file's window."""
    p = pos.join(windows.filter("start IS NOT NULL").select("metadata_id", "start", "stop"), "metadata_id").filter("time_val BETWEEN start AND stop AND v_drain IS NOT NULL AND i_drain IS NOT NULL")
    p = numbered(p.select("metadata_id", "time_val", (F.col("v_drain") * F.col("i_drain")).alias("p"), F.col("position").alias("place")), ["metadata_id"], ["place"])
    p = look_back(p, ["metadata_id"], "position", {"b_time": "time_val", "b_p": "p"}).withColumn("dt", F.greatest(F.col("time_val") - F.col("b_time"), F.lit(0.0)))
    seg = lambda f: (f("p") + f("b_p")) / 2 * F.col("dt")
    clip = lambda c: F.when(F.col("b_p").isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    p = p.withColumn("clip", seg(clip)).withColumn("abs", seg(lambda c: F.abs(c)))
    return p.groupBy("metadata_id").agg(F.sum("clip").alias("energy_j"), F.sum("abs").alias("absolute_j"), F.count("clip").alias("steps"))


def rates(event: DataFrame, span: DataFrame) -> DataFrame:
    """(metadata_id, events, per_second, per_fluence): null where the span is null or 0."""
    n = event.groupBy("metadata_id").agg(F.count("*").alias("events"))
    j = span.join(n, "metadata_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return j.select("metadata_id", "events", F.try_divide("events", "seconds").alias("per_second"), F.try_divide("events", "fluence").alias("per_fluence"))


def spans(pos: DataFrame) -> DataFrame:
    """(metadata_id, seconds, fluence) that a file covers."""
    return pos.groupBy("metadata_id").agg((F.max("time_val") - F.min("time_val")).alias("seconds"), (F.max("fluence") - F.min("fluence")).alias("fluence"))


def pulse_history(pulses: DataFrame, owner: list[str], order: list[str], energy: str) -> DataFrame:
    """pulses plus ordinal and cumulative energy, null from the first unknown energy on."""
    w = Window.partitionBy(*owner).orderBy(*(F.asc_nulls_last(o) for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.col(energy).isNull().cast("int")).over(w)
    return pulses.withColumn("pulse", F.count(F.lit(1)).over(w)).withColumn("cumulative", F.when(broken == 0, F.sum(energy).over(w)))
