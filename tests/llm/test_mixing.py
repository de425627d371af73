"""p9: apportionment against the plain process, quotas, caps and shares."""

import random

from ohmgrid.llm import mixing


def plain(blocks, weights, caps):
    n = [0] * len(weights)
    for _ in range(blocks):
        live = [i for i, w in enumerate(weights) if w > 0 and n[i] < caps[i]]
        if not live:
            break
        n[max(live, key=lambda i: (weights[i] / (2 * n[i] + 1), -i))] += 1
    return n


def test_apportionment_is_the_plain_process():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randint(1, 9)
        w = [rng.choice([0.0, rng.random(), rng.random() * 1e6, 0.25]) for _ in range(k)]
        caps = [rng.choice([0, rng.randint(0, 50), 10**9]) for _ in range(k)]
        blocks = rng.randint(0, 400)
        assert mixing.apportion(blocks, w, caps) == plain(blocks, w, caps)


def tables(spark, sizes, targets):
    rows, k = [], 0
    for s, n in sizes:
        for _ in range(n):
            rows.append((k, s, " word" * 200, "clash"))
            k += 1
    rows += [(k, None, "x", "c"), (k + 1, "a", None, "c"), (k + 2, "a", "", "c"), (k + 3, "unknown", "x y", "c")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, share string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_repeats_and_caps(spark):
    docs, targets = tables(spark, [("a", 300), ("b", 60), ("c", 5)], [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.0, 5), (None, 0.1, 1)])
    chosen = mixing.mix(docs, targets)
    rows = chosen.collect()
    assert all(r.source in "abc" and r.repeats >= 1 and r.n_tokens == 200 for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    most = {"a": 1, "b": 3, "c": 2}
    assert all(r.repeats <= most[r.source] for r in rows)
    got = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    assert got["c"].tokens == 2000  # all it has, twice
    assert abs(got["a"].tokens / got["b"].tokens - 5 / 4) < 0.02
    assert abs(sum(r.tokens for r in got.values()) - 365 * 200) <= 3 * 256 + 3 * 200
    assert got["none"].tokens == 0 and got["none"].actual_share == 0.0


def test_largest_feasible_mix_reaches_every_share(spark):
    docs, targets = tables(spark, [("a", 300), ("b", 60), ("c", 5)], [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.0, 5)])
    got = {r.source: r for r in mixing.shares(mixing.mix(docs, targets, tokens="feasible"), targets).collect()}
    assert abs(sum(r.tokens for r in got.values()) - 20_000) <= 4 * 256  # c has 2,000 for a tenth
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in got.values())


def test_same_seed_same_selection(spark):
    docs, targets = tables(spark, [("a", 50), ("b", 50)], [("a", 0.2, 1), ("b", 0.8, 1)])
    pick = lambda seed: sorted(map(tuple, mixing.mix(docs, targets, tokens=5000, seed=seed).collect()))
    assert pick(1) == pick(1) != pick(2)
    assert abs(sum(r[2] * r[3] for r in pick(1)) - 5000) <= 600


def test_shards_add_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 3000)
    docs, targets = tables(spark, [("a", 200), ("b", 40)], [("a", 0.5, 1), ("b", 0.5, 4)])
    got = {r.source: r.tokens for r in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert abs(got["a"] - 24000) < 2500 and abs(got["b"] - 24000) < 2500


def test_empty(spark):
    docs, targets = tables(spark, [], [("a", 1.0, 1)])
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0
    assert [r.tokens for r in mixing.shares(mixing.mix(docs.limit(0), targets), targets).collect()] == [0]
