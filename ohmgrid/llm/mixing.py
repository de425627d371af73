"""Mixing sources to target shares by Sainte-Lague apportionment of equal blocks of tokens.

The size of the mix is the tokens of all sources with a target and documents, a given number, or the largest at which
no source's cap keeps it from its share. It is cut into blocks of
BLOCK tokens; each block goes to the source with the highest quotient share / (2 * blocks + 1) that still has capacity
(its tokens times max_repeats). A source's blocks are apportioned to its shards in the same way, by their tokens. In a
shard, documents come in a seeded order: whole passes over the shard first, then the documents up to the quota.

Defined results: documents without source, of a source without target, or without tokens are not selected; a target
without documents reaches share 0 and its blocks go to the others; null max_repeats is 1, null or negative target_share
is 0; equal quotients go to the source first by name; empty tables give an empty selection; repeated rows count each.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.llm.tokenizer import VOCABULARY, count_tokens
from ohmgrid.session import materialize

BLOCK = 256
#: Tokens of a shard, and the most shards of a source (so the quotas that the driver sees are bounded).
SHARD_TOKENS, MOST_SHARDS = 2_000_000, 4096


def apportion(blocks: int, weights: list[float], caps: list[int]) -> list[int]:
    """Blocks by the highest quotients weight / (2 n + 1), none beyond its cap, the first of equals first."""
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    n = [0] * len(weights)
    blocks = min(blocks, sum(caps[i] for i in live))
    if not blocks:
        return n
    at = lambda d: [min(caps[i], max(0, math.floor(weights[i] / d + 0.5))) for i in live]
    lo, hi = min(weights[i] for i in live) / (2 * blocks + 2), 4 * max(weights)
    for _ in range(200):  # hi: a divisor that gives at most all blocks
        mid = math.sqrt(lo * hi)
        lo, hi = (lo, mid) if sum(at(mid)) <= blocks else (mid, hi)
        if hi / lo < 1 + 1e-12:
            break
    for i, k in zip(live, at(hi)):
        n[i] = k
    heap = [(-weights[i] / (2 * n[i] + 1), i) for i in live if n[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(blocks - sum(n)):
        _, i = heapq.heappop(heap)
        n[i] += 1
        if n[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * n[i] + 1), i))
    return n


def _sources(counted: DataFrame, targets: DataFrame) -> list:
    """(source, share, most, have) of every target with documents; one row per target."""
    return sorted(targets.join(counted.groupBy("source").agg(F.sum("n_tokens").alias("have")), "source").collect())


def largest_feasible(rows: list) -> int:
    """The most tokens of which every source with documents can give its share (of those sources' shares) within its cap."""
    whole = sum(r.share for r in rows)
    return min((int(r.have * r.most * whole / r.share) for r in rows if r.share > 0), default=0)


def mix(docs: DataFrame, targets: DataFrame, tokens: int | str | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the selected documents. tokens: the size, by default that of all documents of
    a source with a target; `feasible` is the largest size at which every source reaches its share."""
    spark = docs.sparkSession
    t = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    counted = count_tokens(docs.select("doc_id", "source", "text").join(t.select("source"), "source", "left_semi"), vocabulary=vocabulary)
    counted = materialize(counted.filter("n_tokens > 0"), "counted")
    rows = _sources(counted, t)
    total = largest_feasible(rows) if tokens == "feasible" else sum(r.have for r in rows) if tokens is None else tokens
    quota = apportion(total // BLOCK, [r.share for r in rows], [-(-r.have * r.most // BLOCK) for r in rows])
    plan = {r.source: (q, r.most, min(MOST_SHARDS, -(-r.have // SHARD_TOKENS))) for r, q in zip(rows, quota)}
    shards = spark.createDataFrame([(s, p[2]) for s, p in plan.items()], "source string, shards int")
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = counted.join(F.broadcast(shards), "source").withColumn("shard", F.pmod(order, F.col("shards")).cast("int"))
    sizes: dict[str, list] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("have")).collect():  # at most MOST_SHARDS a target
        sizes.setdefault(r.source, []).append((r.shard, r.have))
    quotas = []
    for s, own in sizes.items():
        own.sort()
        blocks = apportion(plan[s][0], [float(h) for _, h in own], [-(-h * plan[s][1] // BLOCK) for _, h in own])
        given = [min(b * BLOCK, h * plan[s][1]) for (_, h), b in zip(own, blocks)]
        quotas += [(s, k, g // h, g % h) for (k, h), g in zip(own, given)]
    quotas = spark.createDataFrame(quotas, "source string, shard int, passes long, rest long")
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    picked = placed.join(F.broadcast(quotas), ["source", "shard"]).withColumn("upto", F.sum("n_tokens").over(w))
    more = F.when(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return picked.select("doc_id", "source", "n_tokens", (F.col("passes") + F.when(F.col("rest") > 0, more).otherwise(0)).cast("int").alias("repeats")).filter("repeats > 0")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, actual_share, most_repeated) of every target."""
    by = selected.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeated"))
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per target
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").withColumn("whole", whole)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("source", "target_share", "max_repeats", zero("documents").alias("documents"), zero("tokens").alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), zero("most_repeated").alias("most_repeated"))
