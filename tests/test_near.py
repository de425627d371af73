"""Searches in sorted order against every pair."""

import duckdb
import numpy as np
import pytest

from ohmgrid.operators import joins, near
from ohmgrid.plans import laboratory, reports


def every_pair(x, y, ids, k, score):
    """The k places in y for each x, with -1 where there are fewer."""
    out = np.full((len(x), k), -1)
    for i in range(len(x)):
        j = np.arange(len(y))
        with np.errstate(all="ignore"):
            s = score(np.full(len(y), i), j)
        best = np.lexsort((ids, np.nan_to_num(s, nan=0.0, posinf=np.inf), np.isnan(s)))[:k]
        out[i, : len(best)] = best
    return out


@pytest.mark.parametrize("digits", [0, 1, 9])
@pytest.mark.parametrize("k", [1, 3])
def test_k_nearest_is_that_of_every_pair(k, digits):
    for seed in range(40):
        g = np.random.default_rng(seed)
        x, y = g.integers(-50, 50, g.integers(0, 40)) / 10, g.integers(-50, 50, g.integers(0, 60)) / 10
        for v in (x, y):
            if seed % 4 == 0 and len(v):
                v[g.integers(0, len(v))] = (np.nan, np.inf, -np.inf)[seed // 4 % 3]
        ids = g.permutation(len(y))
        score = lambda i, j, x=x, y=y: near.half_up(np.abs(x[i] - y[j]), digits)
        assert (near.k_nearest(x, y, ids, k, score) == every_pair(x, y, ids, k, score)).all()


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_nearest_builds_no_pairs_and_ties_by_rounded_distance(spark):
    left = frame(spark, "k int, l long, v double", [(1, 1, 0.3), (1, 2, None), (None, 3, 0.3), (2, 4, 0.0)])
    right = frame(spark, "k int, r long, v double", [(1, 7, 0.5), (1, 8, 0.1), (1, 9, None), (None, 5, 0.3), (3, 6, 0.0)])
    n = joins.nearest(left, right, ["k"], ["v"], {"v": 1.0}, "l", "r", 3)  # 0.3 - 0.1 < 0.5 - 0.3 in doubles
    assert sorted((x.l, x.r, round(x.distance, 9), x.rank) for x in n.collect()) == [(1, 7, 0.2, 1), (1, 8, 0.2, 2)]
    assert "Join" not in n._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    left = frame(spark, "k int, l long, v double", [(i % 2, i, float(i)) for i in range(40)])
    right = frame(spark, "k int, r string, v double", [(i % 2, f"{i:03}", i + 0.25) for i in range(0, 200, 5)])
    got = {x.l: x.r for x in joins.nearest(left, right, ["k"], ["v"], {"v": 1.0}, "l", "r", 1).collect()}
    assert got == {i: min((abs(i - j - 0.25), f"{j:03}") for j in range(0, 200, 5) if j % 2 == i % 2)[1] for i in range(40)}


def every_match(x, y, ids, score):
    one, all_ = np.zeros(len(ids), int), np.arange(len(ids))
    pick = lambda axes, at: [(v[at], known[at]) for v, known in axes]
    s = [score(pick(x, one + i), pick(y, all_)) for i in range(len(x[0][0]))]
    return [int(np.lexsort((ids, np.nan_to_num(v), np.isnan(v)))[0]) for v in s]


def test_best_match_is_that_of_every_pair():
    def score(x, y):
        both = [p & q for (_, p), (_, q) in zip(x, y)]
        with np.errstate(all="ignore"):
            return near.half_up(np.sqrt(sum(np.where(k, (v - w) ** 2, 0.0) for k, (v, _), (w, _) in zip(both, x, y)) / sum(both)), 1)

    for seed in range(60):
        g = np.random.default_rng(seed)
        side = lambda n, g=g: [(g.integers(-40, 40, n) / 10, g.random(n) < 0.9), (g.integers(0, 4, n).astype(float), g.random(n) < 0.8)]
        x, y = side(int(g.integers(1, 30))), side(int(g.integers(1, 60)))
        ids = g.permutation(len(y[0][0]))
        assert near.best_match(x, y, ids, score)[0].tolist() == every_match(x, y, ids, score)


SUPPLIERS = "s_nationkey int, s_suppkey long, s_acctbal double"
CUSTOMERS = "c_nationkey int, c_custkey long, c_acctbal double"


def match(spark, folder, name, customers, suppliers):
    frame(spark, CUSTOMERS, customers).write.parquet(f"{folder}/customer.parquet")
    frame(spark, SUPPLIERS, suppliers).write.parquet(f"{folder}/supplier.parquet")
    got = (reports.QUERIES | laboratory.QUERIES)[name](spark, str(folder))
    return got, sorted(tuple(r) for r in got.collect())


def test_argmin_builds_no_pairs_and_puts_unknown_values_last(spark, tmp_path):
    got, found = match(spark, tmp_path, "match_argmin", [(1, 7, 100.0), (1, 8, 100.0), (2, 9, 1.0)], [(1, 14, None), (1, 21, 90.0), (1, 28, 110.0), (1, 1, 400.0), (3, 2, 1.0)])
    assert found == [(7, 21, 0.1), (8, 1, 3.0)]  # 7 has the code of 21 and 28, which tie; 8 that of 1
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_grid_builds_no_pairs_and_ties_by_rounded_distance(spark, tmp_path):
    got, found = match(spark, tmp_path, "match_grid", [(1, 8, 100.0)], [(1, 21, 100.01), (1, 28, 100.0)])  # codes 1, 0 and 0
    assert found == [(1, 8, 21, 0.35), (2, 8, 28, 0.18), (3, 8, 21, 0.71)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_counts_within_are_those_of_every_pair():
    for seed in range(60):
        g = np.random.default_rng(seed)
        x, y = g.integers(-50, 50, g.integers(0, 40)) / 10, g.integers(-50, 50, g.integers(0, 60)) / 10
        for v in (x, y):
            if seed % 4 == 0 and len(v):
                v[g.integers(0, len(v))] = (np.nan, np.inf, -np.inf)[seed // 4 % 3]
        with np.errstate(all="ignore"):
            d = np.abs(x - (y[0] if len(y) else 1.0))
            assert near.counts_within(x, d, y).tolist() == [int(sum(abs(a - y) <= b)) for a, b in zip(x, d)]


def test_ranking_quality_builds_no_pairs(spark, tmp_path):
    got, found = match(spark, tmp_path, "match_ranking_quality", [(1, 7, 100.0), (1, 8, None), (2, 9, 1.0)], [(1, 21, 90.0), (1, 28, 110.0), (1, 33, 110.0), (1, 25, None), (3, 2, 1.0)])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    for n in ("customer", "supplier"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    assert found == sorted(c.execute(reports.SQL["match_ranking_quality"]).fetchall())


def test_pairs_are_spread_and_rounded_as_in_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(laboratory, "TARGETS", 2)
    got, found = match(spark, tmp_path, "match_axis_distance", [(1, i, 0.0) for i in range(1, 9)] + [(1, 9, 5e15), (2, 10, 1.0)], [(1, i, i + 0.0005) for i in range(1000, 1300)] + [(1, 7, None)])
    c = duckdb.connect()
    for n in ("customer", "supplier"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    key = lambda row: row[:2]
    assert [x for x in found if x[1] != 7] == sorted(c.execute(f"SELECT * FROM ({laboratory.SQL['match_axis_distance']}) WHERE candidate <> 7").fetchall(), key=key)
    assert got.rdd.getNumPartitions() == 5
