"""Implausible readings: robust exponentially weighted control charts with run-length counters and physical limits.

Each series (file, step, channel) is charted against its own behaviour, forwards and backwards. A suspected reading is
clipped before it updates level, trend and scale, so that a spike cannot hide the next one; four suspects in a row are a
lasting step, and the chart starts again from the new level. A suspect becomes a flag only if an exact check of its
neighbours agrees: up to three readings that leave the course on one side and return.

Long series are cut into blocks of points with a margin on both sides, so a hot file is spread over many tasks. Whether
a channel varies at all is decided for the whole (file, step) from counts that add up over the blocks.

Defined results: a null or NaN reading is no reading (skipped, never flagged); rows repeated with the same point_index
and value are one reading, and all of them are flagged together; rows without point_index or metadata_id have no place
in a series and are only held against the physical limit; a file without metadata counts as one without delay_time;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmgrid.session import join_dimension, materialize

CHANNELS = ("v_gate", "i_gate", "i_drain")
#: Readings of this size are overflow marks, not measurements.
LIMIT = 1e30
#: Points in a block, and points added on both sides of it.
BLOCK, MARGIN = 1024, 64
#: Readings in a stuck run; longest spike; times the usual scatter; decades; ramp steps.
RUN, SPIKE, SCATTERS, DECADES, RAMP_STEPS = 10, 3, 10.0, 1.0, 5.0
#: The chart suspects at half of what the check demands. Weights of level, trend and scale.
SUSPECT, LEVEL_W, TREND_W, SCALE_W = 0.5, 0.4, 0.2, 0.05
#: Rows gathered before the charts of all their series run side by side.
BUFFER = 200_000

OUT = "id long, channel int, kind int, metadata_id int, step_index int, changes long, readings long"


def chart(z: np.ndarray, width: np.ndarray, limit: np.ndarray, adapt: np.ndarray, trend: bool) -> np.ndarray:
    """Suspects of the series in the rows of z (padded with NaN), all run side by side along their readings.

    limit is the first half-width of each series in its own unit; where adapt is set it follows the chart's scale.
    """
    s, t = z.shape
    sus = np.zeros((s, t), bool)
    k = min(5, t)
    head = np.where(np.arange(k) < np.minimum(width, k)[:, None], z[:, :k], np.nan)
    with np.errstate(all="ignore"):
        level = np.nanmedian(head, axis=1)
    slope, factor, scale, run = np.zeros(s), limit.copy(), np.ones(s), np.zeros(s, int)
    for j in range(t):
        x = z[:, j]
        on = j < width
        want = level + slope
        r = np.where(on, x - want, 0.0)
        half = np.where(adapt, factor * scale, factor)
        bad = np.abs(r) > half
        sus[:, j] = bad & on
        cut = np.clip(r, -half, half)
        level = want + LEVEL_W * cut
        if trend:
            slope = slope + TREND_W * cut
        size = np.abs(cut) / np.where(factor > 0, factor, 1.0) * (SUSPECT * SCATTERS)
        scale = np.clip((1 - SCALE_W) * scale + SCALE_W * np.minimum(size, 3.0 * scale) * 1.2533, 0.5, 2.0)
        run = np.where(bad, run + 1, 0)
        lasting = (run > SPIKE) & on
        level, slope, run = np.where(lasting, x, level), np.where(lasting, 0.0, slope), np.where(lasting, 0, run)
    return sus


def suspects(z: np.ndarray, start: np.ndarray, count: np.ndarray, limit: np.ndarray, adapt: np.ndarray, trend: bool) -> np.ndarray:
    """chart() for flat series z[start:start+count], forwards and backwards, those of like length together."""
    out = np.zeros(len(z), bool)
    edges = [0, 48, 96, 192, 448, 1 << 62]
    for lo, hi in zip(edges, edges[1:]):
        own = np.flatnonzero((count > lo) & (count <= hi) & (count >= 3) & np.isfinite(limit) & (limit > 0))
        if not len(own):
            continue
        t = int(count[own].max())
        at = np.arange(t)
        on = at < count[own][:, None]
        for way in (1, -1):
            first = start[own] if way == 1 else start[own] + count[own] - 1
            idx = np.where(on, first[:, None] + way * at, start[own][:, None])
            sus = chart(np.where(on, z[idx], np.nan), count[own], limit[own], adapt[own], trend)
            out[idx[on]] |= sus[on]
    return out


def _side(i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (i >= lo) & (i < hi)


def spikes_by_scatter(x: np.ndarray, sus: np.ndarray, lo: np.ndarray, hi: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Stretches of up to SPIKE readings that lie SCATTERS times the scatter beyond the level on both sides of them.

    lo, hi: bounds of each reading's series; a level is the median of the three nearest readings of that side.
    """
    flag = np.zeros(len(x), bool)
    cand = np.flatnonzero(sus & (scatter > 0) & np.isfinite(scatter))
    for length in range(1, SPIKE + 1):
        for off in range(length):
            a = cand - off
            b = a + length
            ok = (a > lo[cand]) & (b < hi[cand]) & (a >= 0)
            c, a, b = cand[ok], a[ok], b[ok]
            if not len(c):
                continue
            before, after = (
                np.nanmedian(np.stack([np.where(_side(p, lo[c], hi[c]), x[np.clip(p, 0, len(x) - 1)], np.nan) for p in ps]), axis=0)
                for ps in ([a - 1, a - 2, a - 3], [b, b + 1, b + 2])
            )
            far = SCATTERS * scatter[c]
            inside = np.stack([x[a + k] for k in range(length)])
            sides = np.stack([before, after, x[a - 1], x[b]])  # the next readings too: a longer excursion is no spike
            up = inside.min(0) - sides.max(0) > far
            down = sides.min(0) - inside.max(0) > far
            flag[c[up | down]] = True
    return flag


def _leaves(y: np.ndarray, sign: np.ndarray, pos: np.ndarray, c: np.ndarray, before: np.ndarray, after: np.ndarray, far: float, margin: float) -> np.ndarray:
    """Whether reading c leaves the line between two others by more than far, beyond both, or has the sign of neither."""
    w = (pos[c] - pos[before]) / np.maximum(pos[after] - pos[before], 1)
    line = y[before] + w * (y[after] - y[before])
    over = np.minimum(y[c] - y[before], y[c] - y[after]) > margin
    under = np.minimum(y[before] - y[c], y[after] - y[c]) > margin
    opposite = (sign[c] * sign[before] < 0) & (sign[c] * sign[after] < 0)
    return ((np.abs(y[c] - line) > far) & (over | under)) | opposite


def spikes_by_course(y: np.ndarray, sign: np.ndarray, pos: np.ndarray, sus: np.ndarray, lo: np.ndarray, hi: np.ndarray, far: float, margin: float) -> np.ndarray:
    """Stretches of up to SPIKE readings that leave the line between the readings around them. Those found are held
    against the nearest readings not found, so ordinary readings between two spikes are given back."""
    flag = np.zeros(len(y), bool)
    cand = np.flatnonzero(sus)
    for length in range(1, SPIKE + 1):
        for off in range(length):
            a = cand - off
            b = a + length
            ok = (a > lo[cand]) & (b < hi[cand])
            c, a, b = cand[ok], a[ok], b[ok]
            good = np.ones(len(c), bool)
            for k in range(length):
                good &= _leaves(y, sign, pos, a + k, a - 1, b, far, margin)
            flag[c[good]] = True
    found = np.flatnonzero(flag)
    if len(found):
        at = np.arange(len(y))
        prev = np.maximum.accumulate(np.where(flag, -1, at))
        nxt = np.minimum.accumulate(np.where(flag, len(y), at)[::-1])[::-1]
        p, n = prev[found], nxt[found]
        inside = (p >= lo[found]) & (n < hi[found])
        keep = np.zeros(len(found), bool)
        keep[inside] = _leaves(y, sign, pos, found[inside], p[inside], n[inside], far, margin)
        flag[found[~keep]] = False
    return flag


def _median_by_series(v: np.ndarray, series: np.ndarray, n: int) -> np.ndarray:
    """Lower median of v by series number; NaN for a series without a value."""
    out = np.full(n, np.nan)
    if len(v):
        o = np.lexsort((v, series))
        own, first, cnt = np.unique(series[o], return_index=True, return_counts=True)
        out[own] = v[o][first + (cnt - 1) // 2]
    return out


def _channel(c: int, cols: dict, group: np.ndarray, out: list) -> None:
    """Flags, stuck readings and counts of one channel over a buffer of whole blocks."""
    x = cols[CHANNELS[c]]
    with np.errstate(invalid="ignore"):
        rows = np.flatnonzero(np.isfinite(x) & (np.abs(x) < LIMIT))
    if not len(rows):
        return
    same = np.zeros(len(rows), bool)
    g, p, v = group[rows], cols["point_index"][rows], x[rows]
    same[1:] = (g[1:] == g[:-1]) & (p[1:] == p[:-1]) & (v[1:] == v[:-1])
    reading = np.cumsum(~same) - 1  # of each row
    pick = np.flatnonzero(~same)
    g, p, v = g[pick], p[pick].astype(float), v[pick]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    count = np.diff(np.append(first, len(g)))
    series = np.repeat(np.arange(len(first)), count)
    lo, hi = first[series], (first + count)[series]
    at0 = rows[pick[first]]
    timed = cols["timed"][at0]
    core = cols["core"][rows[pick]]

    diff = np.abs(np.diff(v))
    within = (np.diff(series) == 0) & (diff > 0)
    step = _median_by_series(diff[within], series[1:][within], len(first))
    sign = np.sign(v)
    flag = np.zeros(len(v), bool)
    by_scatter = timed[series]
    scatter = step / (0.6745 * np.sqrt(2))
    if timed.any():
        z = v / scatter[series]
        sus = suspects(z, first, np.where(timed, count, 0), np.full(len(first), SUSPECT * SCATTERS), np.ones(len(first), bool), False)
        flag |= spikes_by_scatter(v, sus & by_scatter, lo, hi, np.where(by_scatter, scatter[series], np.nan))
    if not timed.all():
        if CHANNELS[c] == "v_gate":
            y, far, none = v / np.where(step > 0, step, np.inf)[series], RAMP_STEPS, np.ones(len(v))
        else:
            y, far, none = np.log10(np.maximum(np.abs(v), 1e-300)), DECADES, sign
        sus = suspects(y, first, np.where(timed, 0, count), np.full(len(first), SUSPECT * far), np.zeros(len(first), bool), True)
        if CHANNELS[c] != "v_gate":
            turn = np.zeros(len(v), bool)
            turn[1:] = (np.diff(series) == 0) & (sign[1:] * sign[:-1] < 0)
            near = turn.copy()
            for k in range(1, SPIKE + 1):
                near[:-k] |= turn[k:]
                near[k:] |= turn[:-k]
            sus |= near
        flag |= spikes_by_course(y, none, p, sus & ~by_scatter, lo, hi, far, 0.3 * far)

    # run-length counters
    turn = np.concatenate([[True], (v[1:] != v[:-1]) | (np.diff(series) != 0)])
    begin = np.flatnonzero(turn)
    length = np.diff(np.append(begin, len(v)))
    run = np.repeat(length, length) >= RUN
    if CHANNELS[c] == "i_drain":
        held = cols["compliance"][rows[pick]]
        at_limit = np.abs(np.abs(v) - np.abs(held)) <= 1e-6 * np.abs(held)
    else:
        at_limit = np.zeros(len(v), bool)
    stuck = run & ~at_limit
    loose = core & ~run
    changes = np.bincount(series, weights=loose & turn, minlength=len(first)).astype(np.int64)
    readings = np.bincount(series, weights=loose, minlength=len(first)).astype(np.int64)

    row_core = cols["core"][rows]
    for kind, hit in ((0, flag), (1, stuck & ~flag)):
        r = rows[hit[reading] & row_core]
        out.append((cols["id"][r], np.full(len(r), c), np.full(len(r), kind), cols["metadata_id"][r], cols["step_index"][r], np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)))
    some = readings > 0
    n = int(some.sum())
    out.append((np.full(n, -1), np.full(n, c), np.full(n, 2), cols["metadata_id"][at0][some], cols["step_index"][at0][some], changes[some], readings[some]))


def _flush(t: pa.Table) -> pa.RecordBatch | None:
    num = lambda n, none: t.column(n).combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)
    cols = {n: num(n, np.nan) for n in (*CHANNELS, "compliance")}
    cols |= {n: num(n, -1) for n in ("id", "metadata_id", "step_index", "block", "point_index")} | {n: num(n, False) for n in ("timed", "core")}
    key = np.stack([cols["metadata_id"], cols["step_index"], cols["block"]])
    group = np.cumsum(np.concatenate([[0], (np.diff(key, axis=1) != 0).any(0)]))
    out: list = []
    with np.errstate(all="ignore"):
        for c in range(len(CHANNELS)):
            _channel(c, cols, group, out)
    if not out:
        return None
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(zip(*out), kinds)], ["id", "channel", "kind", "metadata_id", "step_index", "changes", "readings"])


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather sorted batches, hand on those blocks that are complete, keep the last one for the next buffer."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BUFFER:
            t = pa.Table.from_batches(held)
            key = [t.column(n).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for n in ("metadata_id", "step_index", "block")]
            last = np.logical_or.reduce([k != k[-1] for k in key])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut and (done := _flush(t.slice(0, cut))) is not None:
                yield done
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
    if rows and (done := _flush(pa.Table.from_batches(held))) is not None:
        yield done


def implausible_readings(points: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (id, field_name, reason) of the points flagged: `limit`, `spike` or `stuck`, judged within their own file."""
    names = ("id", "metadata_id", "step_index", "point_index", *CHANNELS)
    p = points.select(*names)
    dim = files.select(F.col("id").alias("metadata_id"), (F.col("delay_time") > 0).alias("timed"), F.col("compliance_ch1").alias("compliance")).filter("metadata_id IS NOT NULL")
    block = F.floor(F.col("point_index") / BLOCK).cast("int")
    off = F.col("point_index") - block * BLOCK
    here = F.struct(block.alias("block"), F.lit(True).alias("core"))
    left = F.when((off < MARGIN) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("core")))
    right = F.when(off >= BLOCK - MARGIN, F.struct((block + 1).alias("block"), F.lit(False).alias("core")))
    placed = join_dimension(p.filter("metadata_id IS NOT NULL AND point_index IS NOT NULL"), dim, "metadata_id", how="left").select(
        *names, F.coalesce("timed", F.lit(False)).alias("timed"), "compliance", F.inline(F.array_compact(F.array(here, left, right)))
    )
    keys = ("metadata_id", "step_index", "block")
    ran = materialize(placed.repartition(*keys).sortWithinPartitions(*keys, "point_index", "id").mapInArrow(_partition, OUT), "chart")
    counts = ran.filter("kind = 2").groupBy("metadata_id", "step_index", "channel").agg(F.sum("changes").alias("c"), F.sum("readings").alias("n"))
    varies = counts.filter("c >= 2 AND 2 * c >= n").select("metadata_id", "step_index", "channel")
    stuck = ran.filter("kind = 1").select("id", "metadata_id", "step_index", "channel").join(varies, ["metadata_id", "step_index", "channel"], "left_semi")
    name = F.element_at(F.array(*map(F.lit, CHANNELS)), F.col("channel") + 1).alias("field_name")
    beyond = p.filter(" OR ".join(f"(abs({c}) >= {LIMIT} AND NOT isnan({c}))" for c in CHANNELS)).select(
        "id", F.explode(F.array_compact(F.array(*(F.when((F.abs(c) >= LIMIT) & ~F.isnan(c), F.lit(c)) for c in CHANNELS)))).alias("field_name")
    )
    return (
        beyond.withColumn("reason", F.lit("limit"))
        .unionByName(ran.filter("kind = 0").select("id", name, F.lit("spike").alias("reason")))
        .unionByName(stuck.select("id", name, F.lit("stuck").alias("reason")))
    )
