"""Candidates that may stand for a target: distances over shared axes, a ladder of evidence, and two rankings.

Pairs are rows with the differences of a target and a candidate. Distances of unlike sets of axes are never compared with
each other: within a target candidates are first ranked among those with the same axes.

Defined results: an axis whose difference is null is left out; a pair without any axis has no distance and comes last;
ties go to the candidate first by source and key; repeated pairs are ranked one after another; empty pairs give an empty
result; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scales:
    """The scale of each axis, weight of the duration, and the distances up to which evidence counts."""

    collapse: float = 0.25
    gate: float = 0.20
    vds: float = 0.15
    duration_weight: float = 0.01
    no_damage: float = 2.50
    mismatch: float = 2.50
    measured: float = 1.75
    weak: float = 3.00
    waveform: float = 1.25


AXES = (("collapse", "collapse_delta"), ("gate", "gate_delta"), ("vds", "normalized_vds_delta"))
#: How near to a proof each status is, 1 the nearest.
PRIORITY = {"measured_damage_candidate": 1, "weak_measured_candidate": 4, "analog_questionable": 5, "waveform_only_candidate": 5, "missing_damage_context": 5}
POSITIVE = ("measured_damage_candidate", "weak_measured_candidate", "waveform_only_candidate")
#: Classes of overlap from best to worst; others come behind.
OVERLAP = ("strong_overlap", "partial_overlap", "near_miss", "far_miss")


def distances(pairs: DataFrame, s: Scales = Scales()) -> DataFrame:
    """pairs plus axes_used, axis_mask, axis_distance (root mean square of the scaled axes), signature_distance (with the
    penalty of the path), waveform_distance (with the duration) and combined_distance (with the damage)."""
    square = [F.pow(F.col(c) / getattr(s, a), 2.0) for a, c in AXES]
    used = sum((F.col(c).isNotNull().cast("int") for _, c in AXES), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in square), F.lit(0.0)), F.nullif(used, F.lit(0)).cast("double"))
    out = pairs.withColumn("axes_used", used).withColumn("axis_mask", F.concat_ws("+", *(F.when(F.col(c).isNotNull(), a) for a, c in AXES))).withColumn("_mean", mean)
    wave = F.col("_mean") + s.duration_weight * F.pow(F.coalesce("duration_log_delta", F.lit(1.0)), 2.0)
    return out.withColumns({
        "axis_distance": F.sqrt("_mean"), "signature_distance": F.sqrt(F.col("_mean") + F.pow(F.coalesce("path_penalty", F.lit(0.0)), 2.0)), "waveform_distance": F.sqrt(wave),
        "combined_distance": F.sqrt(wave + F.pow(F.coalesce("damage_distance", F.lit(s.no_damage)), 2.0)),
    }).drop("_mean")


def classified(pairs: DataFrame, s: Scales = Scales()) -> DataFrame:
    """distances() plus status and priority: what the evidence for a candidate amounts to."""
    d = distances(pairs, s)
    said, wave = F.col("damage_comparability_status"), F.col("waveform_distance")
    status = (
        F.when(F.col("axes_used") == 0, "missing_damage_signature_overlap").when(F.col("axis_distance") > s.mismatch, "damage_signature_mismatch")
        .when(said.isin("strong", "usable") & (wave <= s.measured), "measured_damage_candidate").when((said == "weak") & (wave <= s.weak), "weak_measured_candidate")
        .when(wave <= s.waveform, "waveform_only_candidate").when(said.isNull(), "missing_damage_context").otherwise("inspect_manually")
    )
    capped = F.when((F.col("mechanism_status_ceiling") == "analog_questionable") & F.col("status").isin(*POSITIVE), "analog_questionable").otherwise(F.col("status"))
    return d.withColumn("status", status).withColumn("status", capped).withColumn("priority", _place(F.col("status"), PRIORITY, 6))


def _place(c: Column, places: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, k in places.items():
        out = F.when(c == name, k).otherwise(out)
    return out


def _scope() -> Column:
    return F.when(F.col("match_scope") == "same_device", 0).otherwise(1)


def rank_by_signature(scored: DataFrame, top: int | None = None) -> DataFrame:
    """scored pairs plus mask_rank (within the target and the set of axes, by distance) and candidate_rank: same device
    first, then status, mask_rank, more axes, source and key. top: only the first of each target."""
    tie = ("candidate_source", "candidate_key")
    mask = Window.partitionBy("target_key", "axis_mask").orderBy(F.asc_nulls_last("axis_distance"), F.asc_nulls_last("duration_log_delta"), *tie)
    r = scored.withColumn("mask_rank", F.row_number().over(mask))
    r = r.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("target_key").orderBy(_scope(), "priority", "mask_rank", F.desc("axes_used"), *tie)))
    return r if top is None else r.filter(F.col("candidate_rank") <= top)


def rank_by_energy(scored: DataFrame, top: int | None = None) -> DataFrame:
    """scored pairs whose energies are known plus energy_rank: same device, priority, agreement of the mechanism, overlap of
    the failure fraction and of the terminal energy, how far the severities lie apart on a log scale (else the energies),
    cumulative exposure, key."""
    overlap = lambda c: _place(F.col(c), {n: k for k, n in enumerate(OVERLAP)}, len(OVERLAP))
    regime = _place(F.col("regime_match"), {"mechanism_mismatch": 2, "analog_questionable": 1}, 0)
    exposure = _place(F.col("exposure"), {"cumulative_present": 0, "not_applicable": 1, "cumulative_missing": 2}, 3)
    both = (F.col("failure_fraction") > 0) & (F.col("severity_ratio") > 0)
    apart = F.when(both, F.abs(F.ln(F.when(both, F.col("failure_fraction"))) - F.ln(F.when(both, F.col("severity_ratio"))))).otherwise(F.abs("log_energy_delta"))
    w = Window.partitionBy("target_key").orderBy(_scope(), "priority", regime, overlap("fraction_overlap"), overlap("energy_overlap"), F.asc_nulls_last(apart), exposure, "candidate_key")
    r = scored.filter("energy_rankable").withColumn("energy_rank", F.row_number().over(w))
    return r if top is None else r.filter(F.col("energy_rank") <= top)
