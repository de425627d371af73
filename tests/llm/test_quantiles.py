"""p6: rank error, merging in any order, and the defined results."""

import numpy as np
import pytest

from ohmgrid.llm import quantiles as q


def test_codes_keep_order_and_value():
    x = np.sort(np.concatenate([np.random.default_rng(1).standard_normal(1000) * 10.0 ** np.random.default_rng(2).integers(-30, 29, 1000), [0.0, 1.0, -1.0, 1e-300]]))
    c = q.encode(x)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << q.BITS
    back = q.decode(c)
    assert np.allclose(back[x != 0], x[x != 0], rtol=1e-6)


def test_compression_keeps_counts_and_bound():
    rng = np.random.default_rng(3)
    node = (1 << q.BITS) | q.encode(rng.lognormal(0, 5, 20000))
    g, k, c = q.compress(np.zeros(len(node), np.int64), node, np.ones(len(node), np.int64), np.array([50.0]))
    assert c.sum() == 20000 and len(set(k.tolist())) == len(k) < 3 * 20000 / 50 + 64
    inner = k < 1 << q.BITS
    assert (c[inner] <= 50).all()


def rank_errors(spark, values, by, monkeypatch=None):
    df = spark.createDataFrame([(b, g, float(v)) for b, g, v in values], "batch int, g string, value double").repartition(7)
    nodes = q.digest(df, ["g", "batch"])
    out = q.quantiles(q.merge(nodes, ["g"]), ["g"], (0.0001, 0.1, 0.5, 0.9, 0.99, 1.0)).collect()
    worst = 0
    for r in out:
        x = np.sort([v for _, g, v in values if g == r.g])
        assert r.n == len(x)
        lo, hi = np.searchsorted(x, r.value * (1 - 2e-6 * np.sign(r.value)), "left"), np.searchsorted(x, r.value * (1 + 2e-6 * np.sign(r.value)), "right")
        want = r.q * len(x)
        off = max(0, lo - want, want - hi)
        worst = max(worst, off / len(x))
    return worst, out


@pytest.mark.parametrize("epsilon", [0.002, 0.05])
def test_rank_error_is_bounded(spark, monkeypatch, epsilon):
    monkeypatch.setattr(q, "EPSILON", epsilon)
    monkeypatch.setattr(q, "K", round(q.BITS / epsilon))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(3, 4, 4000), -rng.lognormal(0, 1, 1000), np.full(1500, 7.5)])
    values = [(int(b), "ab"[i % 2], v) for i, (b, v) in enumerate(zip(rng.integers(0, 5, len(x)), x))]
    worst, out = rank_errors(spark, values, ["g"])
    assert worst <= epsilon + 2 / 3000 and len(out) == 12


def test_merged_batches_equal_one(spark):
    rows = [(i % 3, "a", float(i)) for i in range(999)]
    df = spark.createDataFrame(rows, "batch int, g string, value double")
    parts = [q.digest(df.filter(f"batch = {b}"), ["g"]) for b in range(3)]
    both = q.quantiles(q.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"]), ["g"])
    once = q.quantiles(q.merge(q.digest(df, ["g"]), ["g"]), ["g"])
    assert sorted(both.collect()) == sorted(once.collect())


def test_merging_again_keeps_the_bound(spark):
    """Batches merged one after another, each with less than n / K values in a power of two, whose node is not in the task of its subtree."""
    own = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few nodes are one task
    try:
        have = spark.createDataFrame([("a", (1 << q.BITS) | int(q.encode(np.array([1000.0]))[0]), 100 * q.K)], "g string, node long, count long")
        for b in range(2):
            new = spark.createDataFrame([("a", 2.0**e * (1 + (i + b / 2) / 80)) for i in range(80) for e in range(6)], "g string, value double")
            have = q.merge(have.unionByName(q.digest(new, ["g"])), ["g"])
        nodes = have.groupBy("node").agg({"count": "sum"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", own)
    assert sum(r[1] for r in nodes) == 100 * q.K + 960
    assert max(r[1] for r in nodes if r.node < 1 << q.BITS) <= 100


def test_nulls_overflow_empty_and_clash(spark):
    rows = [(None, 1.0, 9), (None, None, 9), ("a", float("nan"), 9), ("a", 1e30, 9), ("a", -1e31, 9), ("b", 0.0, 9), ("b", -0.0, 9), ("b", -2.0, 9)]
    df = spark.createDataFrame(rows, "g string, value double, count int")
    got = {(r.g, r.q): (r.value, r.n) for r in q.quantiles(q.merge(q.digest(df, ["g"]), ["g"]), ["g"]).collect()}
    assert got[None, 0.5][1] == 1 and abs(got[None, 0.5][0] - 1) < 1e-6
    assert got["b", 0.99][1] == 3 and abs(got["b", 0.99][0]) < 1e-300 and ("a", 0.5) not in got
    assert q.quantiles(q.merge(q.digest(df.limit(0), ["g"]), ["g"]), ["g"]).count() == 0


def test_exact_on_the_smallest_table(spark):
    p, f = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("baselines_measurements", "baselines_metadata"))
    v = q.measured(p, f)
    got = q.quantiles(q.merge(q.digest(v, ["measurement_category", "field_name", "ingest_batch"]), ["measurement_category", "field_name"]), ["measurement_category", "field_name"]).collect()
    pdf = v.filter("abs(value) < 1e30").toPandas()
    for r in got:
        own = pdf[(pdf.field_name == r.field_name) & ((pdf.measurement_category == r.measurement_category) | (pdf.measurement_category.isna() & (r.measurement_category is None)))].value.sort_values().to_numpy()
        lo = own[max(0, int(np.ceil(r.q * len(own))) - 1 - r.rank_error)]
        hi = own[min(len(own) - 1, int(np.ceil(r.q * len(own))) - 1 + r.rank_error)]
        assert r.n == len(own) and lo - abs(lo) * 2e-6 <= r.value <= hi + abs(hi) * 2e-6
