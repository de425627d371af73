"""Nearest values on a line within a key, found in sorted order: no pair of rows is built.

Each key's right rows are sorted once; a left row is placed among them by binary search and looks outwards from there, as
far as the order asked for still ties. A score must not fall as |x - y| grows on either side of x.

Left rows of a key are dealt to blocks of about BLOCK rows, each with a copy of the key's right rows, so a hot key is
spread over tasks. A task holds the right rows of one key.

Defined results: null keys and nulls on either side match nothing; equal scores go to the lower id; NaN is the greatest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Left rows in a block.
BLOCK = 50_000
#: Cells looked at in one step.
CELLS = 4_000_000


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded away from zero at halves in binary, as SQL engines round doubles: round(v * 10**d) / 10**d."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        z = np.asarray(v, float) * scale
        whole = np.trunc(z)
        whole += np.copysign(1.0, z) * (np.abs(z - whole) >= 0.5)
        out = whole / scale
    return np.where(np.isfinite(out), out, v)


def k_nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, score: Callable) -> np.ndarray:
    """The places in y of the k rows of lowest (score(x, y), id) for each x, -1 where there are fewer. score takes places
    of x and places of y, as arrays of one shape; NaN scores come last."""
    out = np.full((len(x), k), -1, np.int64)
    if not len(x) or not len(y):
        return out
    up = np.lexsort((ids, y))
    ends = y[up]
    first = np.r_[True, ~((ends[1:] == ends[:-1]) | (np.isnan(ends[1:]) & np.isnan(ends[:-1])))]
    start = np.flatnonzero(first)
    nth = np.arange(len(up)) - start[np.cumsum(first) - 1]
    up = up[nth < k]  # of equal values only the k lowest ids can be among the nearest
    down = up[np.lexsort((-ids[up], y[up]))]  # read from its end: falling values, rising ids
    odd = ~np.isfinite(x)  # without a place in the order
    todo = [(np.flatnonzero(~odd), k + 1), (np.flatnonzero(odd), len(up))]
    values = y[up]
    while todo:
        at, wide = todo.pop()
        wide = min(wide, len(up))
        step = max(1, CELLS // (2 * wide))
        if len(at) > step:
            todo += [(at[i : i + step], wide) for i in range(0, len(at), step)]
            continue
        if not len(at):
            continue
        place = np.searchsorted(values, x[at], "right")[:, None]
        ahead = np.arange(wide)[None, :]
        l, r = place - 1 - ahead, place + ahead
        seen = np.concatenate([l, r], 1)
        there = (seen >= 0) & (seen < len(up))
        inside = np.clip(seen, 0, len(up) - 1)
        row = np.concatenate([down[inside[:, :wide]], up[inside[:, wide:]]], 1)
        with np.errstate(all="ignore"):
            s = score(np.broadcast_to(at[:, None], row.shape), row)
        last = np.isnan(s) + 2 * ~there  # numbers, then NaN, then nothing
        s = np.where(last > 0, 0.0, s)
        order = np.lexsort((ids[row], s, last), axis=1)[:, :k]
        kth = order[:, -1:]
        take = lambda a: np.take_along_axis(a, kth, 1)
        most, kind = take(s), take(last)
        # the farthest row seen on a side still ties with the k-th, or fewer than k were seen: rows beyond it may count
        rim = np.zeros(len(at), bool)
        for c in (wide - 1, 2 * wide - 1):
            more = seen[:, c] > 0 if c < wide else seen[:, c] < len(up) - 1
            rim |= there[:, c] & more & ((last[:, c] < kind[:, 0]) | ((last[:, c] == kind[:, 0]) & (s[:, c] <= most[:, 0])))
        best = np.where(np.take_along_axis(last, order, 1) < 2, np.take_along_axis(row, order, 1), -1)
        done = ~rim
        out[at[done], : best.shape[1]] = best[done]
        if rim.any():
            todo.append((at[rim], 2 * wide))
    return out


def column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, 0 for null, and which are not null."""
    c = table.column(name).cast(pa.float64())
    return c.fill_null(0.0).to_numpy(), c.is_valid().to_numpy()


def ranked(table: pa.Table, name: str) -> np.ndarray:
    """The ids of a column as numbers of the same order."""
    return np.unique(table.column(name).to_numpy(), return_inverse=True)[1]


def by_key(left: DataFrame, right: DataFrame, on: list[str], left_id: str, f: Callable[[pa.Table, pa.Table], list], schema: StructType) -> DataFrame:
    """The columns f makes of the left and right rows of each key that both have, the left rows of a key in blocks."""
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    blocks = max(1, -(-left.count() // BLOCK))
    keys = [*on, "_block"]
    a = left.filter(known).withColumn("_block", F.pmod(F.xxhash64(left_id), F.lit(blocks)).cast("int")).repartition(blocks, *keys)
    b = right.filter(known).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, *keys)
    form = to_arrow_schema(schema)

    def both(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return form.empty_table()
        return pa.table([pa.chunked_array(c.chunks, t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(f(one, other), form.types)], schema=form)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(both, schema)


def counts_within(x: np.ndarray, d: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the values y lie within d of each x: abs(x - y) <= d in doubles, as for every pair; NaN lies nowhere."""
    values = np.sort(y[~np.isnan(y)])
    out = np.zeros(len(x), np.int64)
    with np.errstate(all="ignore"):
        for i in np.flatnonzero(~np.isfinite(x)):  # without a place in the order
            out[i] = np.count_nonzero(np.abs(x[i] - values) <= d[i])
        at = np.flatnonzero(np.isfinite(x))
        if not len(values) or not len(at):
            return out
        xs, ds = x[at], d[at]
        place = np.searchsorted(values, xs, "right")

        def first(low, high, within):
            """The first place in [low, high) that is within, or is not; high where there is none."""
            while (open_ := low < high).any():
                mid = (low + high) // 2
                hit = (np.abs(xs - values[np.minimum(mid, len(values) - 1)]) <= ds) == within
                low, high = np.where(open_ & ~hit, mid + 1, low), np.where(open_ & hit, mid, high)
            return low

        out[at] = first(place, np.full_like(place, len(values)), False) - first(np.zeros_like(place), place, True)
    return out


Axis = tuple[np.ndarray, np.ndarray]


def best_match(left: list[Axis], right: list[Axis], ids: np.ndarray, score: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The place of the right row of lowest (score, id) for each left row, and its score. Axes are columns as column() gives
    them: the first is searched in order within each class of right rows that agree on all others. score takes the axes of
    both sides, as arrays of one shape; NaN is the greatest."""
    n = len(left[0][0])
    best, least = np.full(n, -1), np.full(n, np.nan)
    kind = right[0][1].astype(np.int64)
    for v, known in right[1:]:
        kind = np.unique(kind * (len(v) + 1) + np.where(known, np.unique(v, return_inverse=True)[1] + 1, 0), return_inverse=True)[1]
    (x, has_x), (y, has_y) = left[0], right[0]
    pick = lambda axes, at: [(v[at], known[at]) for v, known in axes]
    for c in range(kind.max() + 1 if len(kind) else 0):
        own = np.flatnonzero(kind == c)
        for has in (True, False):
            rows = np.flatnonzero(has_x == has)
            if not len(own) or not len(rows):
                continue
            line = (x[rows], y[own]) if has and has_y[own[0]] else (np.zeros(len(rows)), np.zeros(len(own)))  # else the axis tells nothing
            scored = lambda i, j: score(pick(left, rows[i]), pick(right, own[j]))  # noqa: B023, E731
            found = k_nearest(*line, ids[own], 1, scored)[:, 0]
            s, at = scored(np.arange(len(rows)), found), own[found]
            new, old = np.isnan(s), np.isnan(least[rows])
            same = (s == least[rows]) | (new & old)
            better = (best[rows] < 0) | (old & ~new) | (s < least[rows]) | (same & (ids[at] < ids[best[rows]]))
            best[rows[better]], least[rows[better]] = at[better], s[better]
    return best, least
