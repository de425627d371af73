"""Joins, series, statistics, events, doses, donors and bounds on rows whose answer is known."""

import math

import pytest
from pyspark.sql import functions as F

from ohmgrid.functions import intervals, parsing, physics
from ohmgrid.operators import bounds, cleaning, dose, donors, events, joins, parameters, proxies, series, statistics
from ohmgrid.plans import relational


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_cleaning(spark):
    d = df(spark, "v_gate double", (9.9e37,), (1.005,), (None,), (-2.5,))
    assert rows(d.select(cleaning.half_up(cleaning.valid("v_gate"), 2))) == rows(df(spark, "x double", (None,), (1.01,), (None,), (-2.5,)))
    assert rows(d.select(cleaning.half_up(cleaning.valid("v_gate"), 0)))[0] == (-3.0,)
    f = d.select(F.size(cleaning.flags(a=F.col("v_gate") > 0, b=F.lit(None).cast("boolean"))))
    assert sorted(r[0] for r in f.collect()) == [0, 0, 1, 1]


def test_joins(spark):
    a, b = df(spark, "k string, x int", ("a", 1), (None, 2)), df(spark, "k string, y int", ("a", 5), (None, 6), ("c", 7))
    assert rows(joins.null_safe(a, b, ["k"])) == [("a", 1, 5), (None, 2, 6)]
    pts = df(spark, "f int, p int", (1, 1), (1, 5), (1, 9), (2, 5))
    assert rows(joins.points_in_intervals(pts, df(spark, "f int, first int, last int", (1, 4, 9)), ["f"], "p").select("f", "p")) == [(1, 5), (1, 9)]
    best = joins.top_one(df(spark, "k int", (1,), (2,)), df(spark, "k int, v int", (1, 5), (1, 9)), ["k"], ["k"], [F.desc("v")])
    assert rows(best) == [(1, 9), (2, None)]
    some = joins.top_one(df(spark, "k int", (1,), (2,)), df(spark, "k int, v int", (1, 5), (1, 9)), ["k"], ["k"], [F.desc("v")], F.col("v") < 9)
    assert rows(some) == [(1, 5), (2, None)]
    n = joins.nearest(df(spark, "k int, l int, a double, b double", (1, 1, 0.0, None), (1, 2, None, None)), df(spark, "k int, r int, a double, b double", (1, 7, 3.0, 1.0), (1, 8, -1.0, None), (1, 9, None, 5.0)), ["k"], ["a", "b"], {"a": 1.0, "b": 1.0}, "l", "r", 2)
    assert [(r.l, r.r, r.distance) for r in n.orderBy("rank").collect()] == [(1, 8, 1.0), (1, 7, 3.0)]


def test_rules_follow_priority_length_and_scope(spark):
    rules = df(spark, "id int, pattern string, pattern_type string, scope string, priority int, part string", (1, "ab", "substring", "all", 1, "short"), (2, "abc", "substring", "all", 1, "long"), (3, "^z\\d", "regex", "s", 5, "regex"), (4, None, "regex", "all", 9, "void"))
    got = joins.by_rules(df(spark, "t string, s string", ("xABCx", "s"), ("ab", None), ("Z9", "s"), ("Z9", "q"), (None, "s")), rules, "t", "s", "part")
    assert rows(got.select("t", "s", "part")) == sorted([("xABCx", "s", "long"), ("ab", None, "short"), ("Z9", "s", "regex"), ("Z9", "q", None), (None, "s", None)], key=str)


def test_rules_of_scope_sc_are_for_sc_ruggedness(spark, tmp_path):
    tables = {
        "baselines_metadata": df(spark, "id int, device_id string, data_source string", (1, "xC1y", "sc_ruggedness"), (2, "xC1y", "baselines"), (3, "xC1y", None)),
        "device_mapping_rules": df(spark, "id int, pattern string, pattern_type string, scope string, priority int, part_number string", (1, "c1", "substring", "sc", 9, "STRONG"), (2, "x", "substring", "all", 1, "WEAK")),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    got = relational.query.queries["join_rules"](spark, str(tmp_path)).collect()
    assert {r.id: r.part_number for r in got} == {1: "STRONG", 2: "WEAK", 3: "WEAK"}


def test_series(spark):
    d = df(spark, "k int, t double, v double", (1, 0.0, 1.0), (1, 1.0, 3.0), (1, 5.0, None), (1, None, 7.0), (2, 0.0, 4.0))
    assert rows(series.trapezoid(d, ["k"], ["t"], "t", "v")) == [(1, 2.0, 1.0, 1), (2, None, None, 0)]
    assert rows(series.first_last(d, ["k"], ["t"], "v")) == [(1, 1.0, 7.0), (2, 4.0, 4.0)]
    assert [r.total for r in series.running_total(d.filter("t IS NOT NULL"), ["k"], ["t"], "v").orderBy("k", "t").collect()] == [1.0, 4.0, None, 4.0]
    p = df(spark, "k int, p int", *[(1, x) for x in (1, 2, 4, 9, 10)])
    assert rows(series.clusters(p, ["k"], "p", 2).select("first", "last", "n")) == [(1, 4, 3), (9, 10, 2)]
    s = series.rolling_step(df(spark, "k int, t int, v double", *[(1, i, v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0, 5.0, 5.0])]), ["k"], ["t"], "v", 3).orderBy("t").collect()
    assert [r.step for r in s] == [0.0, 0.0, 4.0, 4.0, 4.0, 0.0]
    e = series.edge_medians(d, ["k"], ["t"], "v", 1)
    assert rows(e) == [(1, 1.0, 7.0), (2, 4.0, 4.0)]
    assert rows(series.argmax(df(spark, "k int, p int, v double", (1, 2, 5.0), (1, 1, 5.0), (1, 0, None)), ["k"], "v", "p")) == [(1, 1, 5.0)]
    assert series.clusters(p.limit(0), ["k"], "p", 2).count() == 0


def test_numbers_and_looking_back(spark):
    d = df(spark, "k int, t double, i int, position string", *[(1, float(x % 50), x, "clash") for x in range(1000)], (2, None, 1, "c"), (2, 3.0, 9, "c"), (None, 1.0, 1, "c"), (None, 1.0, 0, "c"))
    got = series.numbered(d.repartition(9), ["k"], ["t", "i"]).collect()
    own = {k: [(r.t, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r.position)] for k in (1, 2, None)}
    assert own[1] == sorted((float(x % 50), x) for x in range(1000)) and own[2] == [(3.0, 9), (None, 1)] and own[None] == [(1.0, 0), (1.0, 1)]
    assert sorted(r.position for r in got if r.k == 1) == list(range(1, 1001))
    n = df(spark, "k int, position int, v int", *[(k, p, 10 * p if p != 5 else None) for k in (1, 2) for p in range(1, 30)])
    back = series.look_back(n, ["k"], "position", {"before": "v"}, block=4).collect()
    assert all(r.before == (None if r.position in (1, 6) else 10 * (r.position - 1)) for r in back) and len(back) == 58
    assert series.numbered(d.limit(0), ["k"], ["t"]).count() == 0


def test_bucketed_intervals(spark):
    pts = df(spark, "f int, p double", *[(1, x / 3) for x in range(60)], (2, 5.0), (None, 5.0))
    iv = df(spark, "f int, first double, last double", (1, 2.0, 9.5), (1, 9.0, 9.0), (1, 5.0, 4.0), (2, -5.0, 50.0))
    plain = joins.points_in_intervals(pts, iv, ["f"], "p")
    assert rows(joins.points_in_intervals(pts, iv, ["f"], "p", width=2.5).select(plain.columns)) == rows(plain)


def test_statistics(spark):
    d = df(spark, "g string, m int, v double", ("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 6.0), ("b", 3, None))
    assert rows(statistics.mean_of_means(d, ["g", "m"], ["g"], "v").select("g", "members", "mean")) == [("a", 2, 4.0)]
    assert rows(statistics.median_of_medians(d, ["g", "m"], ["g"], "v")) == [("a", 2, 4.0)]
    w = statistics.weighted_quantile(df(spark, "g int, v double, w double", (1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 8.0), (1, 0.0, None)), ["g"], "v", "w", [0.1, 0.5])
    assert rows(w) == [(1, 0.1, 1.0), (1, 0.5, 3.0)]
    assert rows(statistics.mode(df(spark, "g int, v string", (1, "b"), (1, "a"), (1, None), (1, None)), ["g"], "v")) == [(1, "a", 1)]
    c = statistics.correlations(df(spark, "g int, x double, y double", (1, 1.0, 1.0), (1, 2.0, 8.0), (1, 3.0, 27.0), (1, None, 5.0)), ["g"], "x", "y").first()
    assert c.n == 3 and c.spearman == pytest.approx(1.0) and c.pearson < 1
    s = statistics.robust_sigma(df(spark, "g int, v double", *[(1, float(v)) for v in (0, 0, 0, 0, 0, 6)], *[(2, 1.0), (2, 9.0)]), ["g"], "v")
    assert {r.g: round(r.sigma, 6) for r in s.collect()} == {1: round(math.sqrt(5), 6), 2: 0.0}
    x = df(spark, "b string, v int", ("p", 1), ("p", 2), ("q", 3))
    y = df(spark, "b string, v int", ("p", 2), ("p", 1), ("r", 3))
    mark = lambda z: statistics.fingerprint(z, ["b"], ["v"])
    assert {(r.b, r.change) for r in statistics.snapshot_diff(mark(x), mark(y), ["b"]).collect()} == {("q", "removed"), ("r", "added")}


POINTS = "metadata_id int, point_index int, time_val double, v_gate double, i_gate double, v_drain double, i_drain double, fluence double"


def test_active_windows(spark):
    def window(fluence, current=None, compliance=None, second=None):
        pts = [(1, k, float(k), 0.0, 0.0, 100.0, (current or [1e-6] * 9)[k], f) for k, f in enumerate(fluence)]
        f = df(spark, "id int, compliance_ch1 double, compliance_ch2 double", (1, compliance, second))
        p = events.positioned(df(spark, POINTS, *pts))
        w = events.active_window(p, f)
        flags = [(r.active, r.integrable, r.exclusion) for r in events.point_flags(p, w).orderBy("position").collect()]
        return w.first(), flags

    # an active window by steps of fluence
    w, flags = window([0.0, 0.0, 5.0, 10.0, 10.0])
    assert (w.basis, w.reason, w.comparable) == ("fluence_positive_delta", "none", True)
    assert (w.active_start, w.active_stop, w.start, w.stop) == (1.0, 3.0, 1.0, 3.0)
    assert [f[1] for f in flags] == [False, True, True, True, False] and not flags[0][0] and flags[4][2] == "outside_active_window"
    # compliance in the middle
    w, flags = window([0.0, 5.0, 10.0, 15.0], [1e-6, 2e-6, 9.95e-3, 1.1e-2], 0.01)
    assert (w.reason, w.failure, w.stop, w.comparable) == ("current_compliance", 2.0, 2.0, False)
    assert flags[3][1:] == (False, "post_failure_or_compliance")
    assert window([0.0, 5.0, 10.0, 15.0], [1e-6, 2e-6, 9.95e-3, 1.1e-2], 5.0, 0.01)[0].failure == 2.0
    # no compliance known: 10 mA
    w, flags = window([0.0, 5.0, 10.0, 15.0], [1e-6, 2e-6, 1.2e-2, 2.0e-2])
    assert (w.reason, w.failure, w.stop, w.comparable) == ("heuristic_current_plateau", 2.0, 2.0, False) and not flags[3][1]
    # no fluence
    w, flags = window([None, None, None])
    assert (w.basis, w.reason, w.start, w.stop, w.comparable) == ("unknown_no_fluence", "active_window_unknown", None, None, False) and not any(f[1] for f in flags)
    # falling fluence
    w, _ = window([0.0, 5.0, 1.0, 6.0])
    assert (w.basis, w.reason, w.start, w.stop, w.comparable) == ("fluence_reset_artifact", "fluence_reset_artifact", None, None, False)
    # a crossing before the beam is none
    w, _ = window([0.0, 0.0, 0.0, 5.0, 10.0], [2e-2, 1e-6, 1e-6, 1e-6, 1e-6])
    assert (w.start, w.stop, w.failure, w.comparable) == (2.0, 4.0, None, True)
    assert window([0.0, 0.4, 0.8])[0].basis == "fluence_static_or_missing_progression"


def test_refined_categories(spark):
    s = "metadata_id int, min_v_drain double, max_v_drain double, min_i_drain double, max_i_drain double"
    e = df(spark, s, (1, 0.0, 40.0, 0.0, 0.5), (2, -30.0, 40.0, -0.5, 0.5), (3, 0.0, 40.0, 0.0, 2.0), (4, -5.0, 0.2, -0.1, 0.0), (5, -5.0, 0.2, -1e-8, 0.0), (6, 0.0, 40.0, None, None), (7, 0.0, 40.0, 0.0, 0.5))
    f = df(spark, "id int, measurement_category string", *((i, "IdVd") for i in range(1, 7)), (7, "IdVg"))
    assert {r.metadata_id: r.refined for r in parameters.refined_category(e, f).collect()} == {1: "Blocking", 2: "Blocking", 3: "IdVd", 4: "3rd_Quadrant", 5: "IdVd", 6: "Blocking", 7: "IdVg"}


def test_slow_ramps_are_events(spark):
    current = [1e-6 + (1e-12 * (k % 2)) + max(0, min(k - 1020, 6)) * 0.5e-6 for k in range(1100)]  # half the floor in each step, over a block's edge
    pts = [(1, k, float(k), 0.0, 1e-12, 100.0, c, None) for k, c in enumerate(current)]
    got = events.candidates(events.positioned(df(spark, POINTS, *pts)), events.Detector(sigmas=0.0)).collect()
    assert got and min(r.position for r in got) >= 1020 and max(r.position for r in got) <= 1030 and max(r.d_drain for r in got) > 1.4e-6


def test_events(spark):
    current = [1e-6 * (1 + 0.01 * (k % 3)) for k in range(40)]
    gate = [1e-9 * (1 + 0.01 * (k % 3)) for k in range(40)]
    for k in range(20, 40):
        current[k] += 1e-3
        gate[k] += 8e-4
    pts = [(1, k, float(k), 0.0, gate[k], 100.0 if k < 20 else 30.0, current[k], None) for k in range(40)]
    e = events.collapse(events.events(events.positioned(df(spark, POINTS, *pts)))).collect()
    # the ramp sees the step one point early: two of the three points from k = 19 on are high
    assert len(e) == 1 and e[0].kind == "drain_gate" and (e[0].first, e[0].last) == (20, 22) and e[0].collapse == pytest.approx(0.7)
    assert events.events(events.positioned(df(spark, POINTS, *pts[:20]))).count() == 0
    h = events.pulse_history(df(spark, "d int, s int, e double", (1, 1, 1.2), (1, 0, 1.0), (1, 2, None), (1, 3, 1.0)), ["d"], ["s"], "e").orderBy("s").collect()
    assert [(r.pulse, r.cumulative) for r in h] == [(1, 1.0), (2, 2.2), (3, None), (4, None)]


def test_dose(spark):
    assert df(spark, "f double", (1e10,)).select(physics.dose_gray(F.col("f"), F.lit(0.1))).first()[0] == pytest.approx(160.2176634)
    layers = df(spark, "layer_order int, thickness_um double, density double, area_cm2 double", (2, 5000.0, 3.21, 0.02), (1, 10.0, 3.21, 0.02))
    stopping = df(spark, "energy double, total double", (1.0, 0.21), (10.0, 0.051))
    c = df(spark, "context_id int, energy_mev double, fluence double", (1, 1.0, 1e6), (2, None, 1e6))
    got = {(r.context_id, r.layer_order): r for r in dose.through_layers(c, layers, stopping).collect()}
    energy = 1.0
    for _ in range(dose.STEPS):
        energy = max(0.0, energy - 0.21 * (10e-4 * 3210 / dose.STEPS)) if energy > 0 else 0.0
    assert got[1, 1].energy_out == pytest.approx(energy, rel=1e-9, abs=1e-12) and got[1, 2].energy_in == got[1, 1].energy_out
    assert got[1, 2].energy_out == 0.0 and got[2, 1].gray is None
    total = {r.context_id: r.joule for r in dose.total_dose(dose.through_layers(c, layers, stopping)).collect()}
    assert total[1] == pytest.approx(1e6 * 0.02 * dose.JOULE_PER_MEV)
    x = df(spark, "e double", (0.5,), (math.sqrt(10),), (100.0,)).withColumn("t", F.array(*(F.struct(F.lit(e).alias("energy"), F.lit(v).alias("total")) for e, v in ((1.0, 0.2), (10.0, 0.05)))))
    assert [round(r[0], 6) for r in x.select(dose.log_log(F.col("e"), F.col("t"), "total")).collect()] == [0.2, 0.1, 0.05]


def test_donors(spark):
    x = df(spark, "id int, g string, s int, f double, y double", *[(i, "a", i % 2, float(i), float(i)) for i in range(10)], (20, "b", 0, 1.0, 1.0), (30, "a", 0, None, 5.0))
    p = {r.id: r for r in donors.predictions(x, x, ["g"], ["f"], {"f": 1.0}, "id", "y", k=3).collect()}
    assert p[0].p50 == 1.0 and p[0].donors == 3 and 20 not in p and 30 not in p
    apart = {r.id: r for r in donors.predictions(x, x, ["g"], ["f"], {"f": 1.0}, "id", "y", k=3, apart="s").collect()}
    assert apart[4].p50 in (3.0, 5.0) and apart[4].donors == 3


def test_bounds(spark):
    d = df(spark, "k int, b string, v double, failed boolean", *[(1, "x", v, v > 5) for v in (1.0, 2.0, 3.0, 6.0, 7.0, 8.0)], (1, "y", 100.0, True), (2, "x", 1.0, False), (2, "x", -1.0, True))
    got = {r.k: (r.low, r.high, r.usable) for r in bounds.bracket(d, ["k"], "b", "v", "failed").collect()}
    assert got == {1: (3.0, 6.0, True), 2: (None, None, False)}
    i = df(spark, "a double, b double, c double, d double", (0.0, 10.0, 2.0, 8.0), (0.0, 10.0, 9.0, 19.0), (0.0, 1.0, 1.5, 3.0), (0.0, 1.0, 9.0, 10.0), (1.0, 0.0, 0.0, 1.0), (None, 1.0, 0.0, 1.0))
    assert [r[0] for r in i.select(intervals.overlap("a", "b", "c", "d")).collect()] == ["strong_overlap", "partial_overlap", "near_miss", "far_miss", "missing_interval", "missing_interval"]
    c = df(spark, "x int, s string", (1, "a"), (2, "a"), (1, "b"), (1, None))
    assert rows(bounds.chart_query(c, ["s"], {"n": "count(*)"}, series=["x"], series_limit=1)) == sorted([("a", 1, 1), ("b", 1, 1), (None, 1, 1)], key=str)


def test_gates(spark):
    v = df(spark, "g string, o int, v double", *[("a", k, 2.0 + 0.1 * k) for k in range(5)], ("a", 9, 50.0), ("a", 9, None), ("b", 1, 1.0))
    got = sorted((r.g, r.decision) for r in parameters.population_gate(v, "g", "v").collect())
    assert got == [("a", "inside")] * 5 + [("a", "no value"), ("a", "outside"), ("b", "too few")]
    low = df(spark, "g string, o int, v double", *[("a", k, 2.0 + 0.1 * k) for k in range(5)], ("a", 4, -1.0))
    assert {(r.o, r.flagged) for r in parameters.flag_devices(low, "g", "o", "v").collect()} == {(0, False), (1, False), (2, False), (3, False), (4, True)}


def test_parsing(spark):
    n = df(spark, "n string", ("W5_C7_IdVg_fwd_-50V_003.csv",), ("dut 25C pulse12",), ("x/3_after800V10us/RT.csv",), (None,))
    got = n.select(parsing.chip(F.col("n")), parsing.bias(F.col("n")), parsing.temperature(F.col("n")), parsing.pulse(F.col("n")), parsing.category(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("W05_C07", -50.0, None, None, "IdVg"), (None, None, 25.0, 12, "Other"), (None, 800.0, 25.0, 3, "Other"), (None, None, None, None, None)]


PAIR = "target_key string, candidate_key string, candidate_source string, match_scope string, collapse_delta double, gate_delta double, normalized_vds_delta double, duration_log_delta double, path_penalty double, damage_distance double, damage_comparability_status string, mechanism_status_ceiling string, log_energy_delta double"


def test_candidate_status(spark):
    def scored(vds, ceiling=None, energy=None):
        return proxies.classified(df(spark, PAIR, ("t", "c", "sc", "same_device", 0.05, 0.02, vds, 0.0, 0.15, 0.25, "usable", ceiling, energy))).first()

    far = scored(0.70)
    assert far.axes_used == 3 and far.signature_distance > 2.50 and far.status == "damage_signature_mismatch"
    near = scored(None)
    assert near.axes_used == 2 and near.signature_distance < 2.50 and near.status == "measured_damage_candidate"
    assert scored(None, energy=10.0).status == "measured_damage_candidate"
    assert near.axis_distance < near.signature_distance
    assert scored(None, "analog_questionable").status == "analog_questionable"
    none = proxies.classified(df(spark, PAIR, ("t", "c", "sc", "same_device", None, None, None, None, None, None, None, None, None))).first()
    assert none.status == "missing_damage_signature_overlap" and none.axis_distance is None


def test_candidate_ranks_by_mask(spark):
    s = "target_key string, candidate_key string, candidate_source string, match_scope string, axis_mask string, axis_distance double, duration_log_delta double, priority int, axes_used int"
    rank = lambda *r: [(x.candidate_key, x.mask_rank) for x in proxies.rank_by_signature(df(spark, s, *[("t", *y) for y in r])).orderBy("candidate_rank").collect()]
    assert rank(("a", "avalanche", "same_device", "collapse", 0.01, None, 1, 1), ("b", "sc", "same_device", "collapse+gate", 0.5, None, 1, 2)) == [("b", 1), ("a", 1)]
    assert rank(("a", "avalanche", "same_device", "collapse", 0.1, None, 1, 1), ("b", "sc", "same_device", "collapse+vds", 0.1, None, 1, 2)) == [("b", 1), ("a", 1)]
    assert rank(("far", "sc", "same_device", "collapse+gate", 0.5, None, 1, 2), ("close", "sc", "same_device", "collapse+gate", 0.1, None, 1, 2)) == [("close", 1), ("far", 2)]
    assert rank() == []


def test_overlap_classes_and_pulse_counters(spark):
    i = df(spark, "a double, b double, c double, d double", (1.0, 2.0, 1.2, 3.0), (1.0, 2.0, 1.9, 3.0), (1.0, 2.0, 2.5, 4.0), (1.0, 2.0, 9.0, 10.0), (1.0, 1.0, 0.0, 2.0), (1.0, 1.0, 2.0, 3.0), (2.0, 1.0, 1.0, 2.0), (None, 1.0, 1.0, 2.0))
    assert [r[0] for r in i.select(intervals.overlap("a", "b", "c", "d")).collect()] == ["strong_overlap", "partial_overlap", "near_miss", "far_miss", "strong_overlap", "far_miss", "missing_interval", "missing_interval"]
    p = df(spark, "n string, k int", ("RP10_1.4J_Vg-1000001.h5", None), ("C2M0080120D_C100002.h5", 42), ("C2M0080120D_C100002.h5", None), ("x_5.2A00007_y.h5", None))
    assert [r[0] and tuple(r[0]) for r in p.select(parsing.avalanche_counter(F.col("n"), F.col("k"))).collect()] == [(1, "avalanche_filename_vg_counter"), (42, "avalanche_shot_index_metadata"), None, (7, "avalanche_filename_current_counter")]
    q = df(spark, "n string, k int", ("sample_pulse12.csv", None), ("device/3_after800V10us/capture.csv", None), ("600V8us.csv", None))
    assert [r[0] and tuple(r[0]) for r in q.select(parsing.sc_counter(F.col("n"), F.col("k"))).collect()] == [(12, "sc_filename_pulse_counter"), (3, "sc_filename_after_counter"), None]
