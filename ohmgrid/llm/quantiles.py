"""Percentiles with deterministic rank error from mergeable digests of dyadic-tree counts.

A double is mapped, in order, to one of 2**32 codes (sign, exponent and 20 bits of the mantissa: a value is kept to one
part in a million). A digest counts nodes of the binary tree over the codes; small sibling counts move up to their parent
while the three together stay within n / K, so a node above the leaves never holds more than that. Digests of partitions,
batches or days are merged by adding the counts of equal nodes. A quantile's rank is off by at most 32 n / K = EPSILON n,
whatever the order of merging.

Digests are built map-side for each partition, merged by a partial aggregation, and compressed subtree by subtree, so no
task sees more than one subtree of a group.

Defined results: nulls, NaN and values of 1e30 or more in size are left out; a group without values gives no row; a null
group is a group of its own; repeated rows count each; equal values share a code; empty tables give empty digests; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.session import join_dimension, materialize

BITS = 32
#: Most rank error as a part of n.
EPSILON = 0.002
K = round(BITS / EPSILON)
LIMIT = 1e30
#: Levels above the leaves that one task compresses for each subtree.
SUBTREE = 20
#: Nodes that a partition gathers before it compresses them.
GATHER = 1_000_000


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of doubles, in the order of the doubles."""
    u = np.ascontiguousarray(x + 0.0).view(np.uint64)
    u = np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))
    return (u >> np.uint64(32)).astype(np.int64)


def decode(code: np.ndarray) -> np.ndarray:
    """The double in the middle of each code's range."""
    u = (code.astype(np.uint64) << np.uint64(32)) | np.uint64(1 << 31)
    u = np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u)
    return u.view(np.float64)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, most: np.ndarray, top: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes (heap numbers: 1 is the root, 2 i and 2 i + 1 the children of i) after moving small counts up.

    most: largest count that a node above the leaves may take on, by group. Nodes at level top stay.
    """
    level = np.frexp(node.astype(float))[1] - 1
    by = {int(v): np.flatnonzero(level == v) for v in np.unique(level)}
    out: list[tuple] = []
    g, k, c = (np.zeros(0, np.int64),) * 3
    for v in range(max(by, default=0), -1, -1):
        if v in by:
            i = by[v]
            g, k, c = np.concatenate([g, group[i]]), np.concatenate([k, node[i]]), np.concatenate([c, count[i]])
        if not len(g):
            continue
        key, inv = np.unique((g << 33) | k, return_inverse=True)
        c = np.bincount(inv, weights=c).astype(np.int64)
        g, k = key >> 33, key & ((1 << 33) - 1)
        if v <= top:
            out.append((g, k, c))
            g, k, c = (np.zeros(0, np.int64),) * 3
            continue
        up, inv = np.unique((g << 33) | (k >> 1), return_inverse=True)
        both = np.bincount(inv, weights=c).astype(np.int64)
        if v - 1 in by:  # what the parent has already
            i = by[v - 1]
            own, place = np.unique((group[i] << 33) | node[i], return_inverse=True)
            has = np.bincount(place, weights=count[i])
            at = np.minimum(np.searchsorted(own, up), len(own) - 1)
            both = both + np.where(own[at] == up, has[at], 0).astype(np.int64)
        move = (both <= most[up >> 33])[inv]
        out.append((g[~move], k[~move], c[~move]))
        g, k, c = g[move], k[move] >> 1, c[move]
    if not out:
        return group[:0], node[:0], count[:0]
    return tuple(np.concatenate(x) for x in zip(*out))


def _build(groups: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        own = [np.zeros(0, np.int64)] * 3
        kinds: list[pa.DataType] = []

        def shrink(most: bool) -> None:
            key, inv = np.unique((own[0] << 33) | own[1], return_inverse=True)
            own[:] = key >> 33, key & ((1 << 33) - 1), np.bincount(inv, weights=own[2]).astype(np.int64)
            if most and len(key):
                n = np.bincount(own[0], weights=own[2], minlength=len(names))
                own[:] = compress(*own, np.floor(n / K))

        for b in batches:
            kinds = [b.schema.field(f).type for f in groups]
            t = pa.table({f: b.column(b.schema.get_field_index(f)) for f in groups})
            codes = np.zeros(b.num_rows, np.int64)
            parts = []
            for f in groups:
                e = t.column(f).combine_chunks().dictionary_encode()
                parts.append(e.dictionary.to_pylist())
                codes = codes * (len(parts[-1]) + 1) + e.indices.fill_null(len(parts[-1])).to_numpy(zero_copy_only=False)
            seen, inv = np.unique(codes, return_inverse=True)
            ids = []
            for s in seen.tolist():
                label = []
                for p in reversed(parts):
                    s, r = divmod(s, len(p) + 1)
                    label.append(p[r] if r < len(p) else None)
                ids.append(names.setdefault(tuple(reversed(label)), len(names)))
            x = b.column(b.schema.get_field_index("value")).to_numpy(zero_copy_only=False)
            for a, new in enumerate((np.array(ids, np.int64)[inv], (1 << BITS) | encode(x), np.ones(len(x), np.int64))):
                own[a] = np.concatenate([own[a], new])
            if len(own[0]) > GATHER:
                shrink(False)
                if len(own[0]) > GATHER // 2:
                    shrink(True)
        if len(own[0]):
            shrink(True)
            labels = list(names)
            cols = [pa.array([x[f] for x in labels], kinds[f]).take(pa.array(own[0])) for f in range(len(groups))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(own[1]), pa.array(own[2])], [*groups, "node", "count"])

    return run


def _schema(df: DataFrame, groups: list[str]) -> str:
    return ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups), "node long, count long"])


def digest(values: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, node, count): mergeable counts of the column value, one set for each group and partition of values."""
    v = F.col("value")
    clean = values.select(*groups, v.cast("double").alias("value")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT))
    return clean.mapInArrow(_build(groups), _schema(values, groups))


def _squeeze(groups: list[str]) -> Callable:
    """Compresses subtrees that come one after another; whole ones are handed on, so about GATHER nodes are held at once."""

    def done(t: pa.Table) -> pa.RecordBatch:
        get = lambda n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False)
        own, place = np.unique(get("gid").astype(np.int64), return_inverse=True)
        most = np.zeros(len(own))
        most[place] = np.floor(get("n") / K)
        g, k, c = compress(place, get("node"), get("count"), most, top=BITS - SUBTREE)
        first = np.zeros(len(own), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        cols = [t.column(f).combine_chunks().take(pa.array(first[g])) for f in groups]
        return pa.RecordBatch.from_arrays([*cols, pa.array(k), pa.array(c)], [*groups, "node", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= GATHER:
                t = pa.Table.from_batches(held)
                gid, root = (t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("gid", "root"))
                other = np.flatnonzero((gid != gid[-1]) | (root != root[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def merge(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """Digests added up for each group and compressed again to at most about 3 K nodes and the subtrees' roots, each root with its subtree."""
    added = materialize(nodes.groupBy(*groups, "node").agg(F.sum("count").alias("count")), "nodes")
    total = added.groupBy(*groups).agg(F.sum("count").alias("n")).withColumn("gid", F.xxhash64(*(F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in groups)))
    total = total.select(*(F.col(g).alias(f"of_{g}") for g in groups), "n", "gid")
    keyed = added.join(total, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups]).select(*groups, "node", "count", "n", "gid")
    depth = F.floor(F.log2(F.col("node").cast("double")))
    root = F.when(depth >= BITS - SUBTREE, F.floor(F.col("node") / F.pow(F.lit(2.0), depth - (BITS - SUBTREE)))).otherwise(-1)
    keyed = keyed.withColumn("root", root.cast("long")).repartition("gid", "root").sortWithinPartitions("gid", "root")
    return keyed.mapInArrow(_squeeze(groups), _schema(nodes, groups))


def quantiles(nodes: DataFrame, groups: list[str], at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(groups, q, value, n, rank_error): each quantile of each group from its merged digest."""
    depth = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    high = F.expr(f"(node + 1) * CAST(pow(2.0D, {BITS} - CAST(floor(log2(CAST(node AS DOUBLE))) AS INT)) AS BIGINT) - 1 - {1 << BITS}L")
    w = Window.partitionBy(*groups).orderBy("high", F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    run = nodes.withColumn("depth", depth).withColumn("high", high).withColumn("upto", F.sum("count").over(w)).withColumn("n", F.sum("count").over(whole))
    q = F.explode(F.array(*map(F.lit, at))).alias("q")
    hit = run.select("*", q).filter(F.col("upto") >= F.ceil(F.col("q") * F.col("n")))
    best = hit.groupBy(*groups, "q").agg(F.min("high").alias("code"), F.first("n").alias("n"))
    return best.select(*groups, "q", _value("code").alias("value"), "n", F.floor(F.col("n") * EPSILON).alias("rank_error"))


def _value(c: str):
    """decode() of a code column as an expression: the middle of the code's range of doubles."""
    u = F.expr(f"({c} << 32) | 2147483648L")  # bits with the sign turned
    bits = F.when(u < 0, u.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(F.bitwise_not(u))
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    normal = (fraction + 1.0) * F.pow(F.lit(2.0), exponent.cast("double") - 1023.0)
    size = F.when(exponent == 0, fraction * 2.0**-1022).otherwise(normal)
    return F.when(bits < 0, -size).otherwise(size)


def measured(points: DataFrame, files: DataFrame) -> DataFrame:
    """(measurement_category, ingest_batch, field_name, value) of rds and bv."""
    dim = files.select(F.col("id").alias("metadata_id"), "measurement_category", "ingest_batch")
    has = points.select("metadata_id", "rds", "bv").filter("rds IS NOT NULL OR bv IS NOT NULL")
    j = join_dimension(has, dim, "metadata_id")
    pair = F.explode(F.array(F.struct(F.lit("rds").alias("field_name"), F.col("rds").alias("value")), F.struct(F.lit("bv").alias("field_name"), F.col("bv").alias("value")))).alias("x")
    return j.select("measurement_category", "ingest_batch", pair).select("measurement_category", "ingest_batch", "x.*").filter("value IS NOT NULL")
