"""Connected components by alternating large-star and small-star steps, each a partial aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmgrid.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node in edges (u, v); self loops and nulls are left out.

    The number of rounds grows with the logarithm of the components' size; no neighbourhood is gathered in one row, so a
    node with a third of all edges is aggregated map-side and its join is split by adaptive execution.
    """
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        small = small.select("x.u", "x.v").filter("u <> v").distinct()
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        nxt = materialize(large, "edges")
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = mark(nxt) == mark(e)
        e = nxt
        if done:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
