"""p5: planted spikes, stuck runs and overflows against sequences whose answer is known."""

import numpy as np

from ohmgrid.operators import control_chart as cc

POINTS = "id long, metadata_id int, step_index int, point_index int, v_gate double, i_gate double, i_drain double, note string"
FILES = "id int, delay_time double, compliance_ch1 double, note string"


def flags(spark, rows, files):
    got = cc.implausible_readings(spark.createDataFrame(rows, POINTS), spark.createDataFrame(files, FILES)).collect()
    return {(r.id, r.field_name): r.reason for r in got}


def series(f, v_gate, i_gate, i_drain, first=0, step=0):
    none = lambda a, k: None if a is None else (None if a[k] is None else float(a[k]))
    n = len(next(a for a in (v_gate, i_gate, i_drain) if a is not None))
    return [(first + k, f, step, k, none(v_gate, k), none(i_gate, k), none(i_drain, k), "x") for k in range(n)]


def noise(n, level, scatter, seed=0):
    return level + scatter * np.random.default_rng(seed).standard_normal(n)


def test_timed_spikes_steps_and_drift(spark):
    x = noise(300, 1e-6, 1e-9)
    x[50] += 5e-8
    x[90:93] -= 4e-8
    x[150:] += 3e-7  # a lasting step
    x[200:] += np.arange(100) * 2e-10  # drift
    x[160:164] += 5e-8  # four readings are no spike
    got = flags(spark, series(1, None, None, x), [(1, 0.5, 0.01, "y")])
    assert got == {(k, "i_drain"): "spike" for k in (50, 90, 91, 92)}


def test_sweep_factor_sign_and_ramp(spark):
    v = np.linspace(-5, 20, 101)
    i = 10 ** np.minimum(-9 + 0.3 * np.arange(101), -2.5 + 0.001 * np.arange(101))
    g = noise(101, 2e-11, 1e-12)
    v2, i2, g2 = v.copy(), i.copy(), g.copy()
    v2[40] += 2.0
    v2[60:62] -= 1.5
    i2[8] *= 40
    i2[70:73] /= 30
    g2[30] = -g2[30] * 3
    got = flags(spark, series(1, v2, g2, i2), [(1, None, 0.5, "y")])
    assert got == {(k, c): "spike" for k, c in [(40, "v_gate"), (60, "v_gate"), (61, "v_gate"), (8, "i_drain"), (70, "i_drain"), (71, "i_drain"), (72, "i_drain"), (30, "i_gate")]}


def test_steep_start_is_normal(spark):
    i = np.concatenate([noise(40, 1e-10, 1e-12), 10 ** np.linspace(-7, -3, 20)])
    assert flags(spark, series(1, None, None, i), [(1, None, 1.0, "y")]) == {}


def test_stuck_compliance_constant(spark):
    x = noise(80, 1e-3, 1e-5)
    x[20:32] = x[20]
    x[50:59] = x[50]  # nine readings are no run
    held = np.concatenate([10 ** np.linspace(-8, -3, 40), np.full(30, 1e-2)])
    rows = series(1, np.full(80, 18.0), None, x) + series(2, None, None, held, first=1000)
    got = flags(spark, rows, [(1, None, 0.5, "y"), (2, None, 0.01, "y")])
    assert got == {(k, "i_drain"): "stuck" for k in range(20, 32)}


def test_limits_nulls_repeats_and_orphans(spark):
    x = list(noise(40, 1e-3, 1e-5))
    x[5], x[9], x[12], x[20] = 9.9e37, None, float("nan"), float("-inf")
    x[30] *= 100
    rows = series(1, None, None, x)
    rows += [(100 + k, *rows[k][1:]) for k in (5, 30)]  # repeated rows
    rows += [(200, None, 0, 1, None, None, 1e31, "x"), (201, 7, None, None, 1e30, None, 1.0, "x"), (202, 9, 0, 0, 1.0, 1.0, 1.0, "x")]
    got = flags(spark, rows, [(1, None, 0.5, "y")])
    want = {(k, "i_drain"): "limit" for k in (5, 105, 20, 200)} | {(k, "i_drain"): "spike" for k in (30, 130)} | {(201, "v_gate"): "limit"}
    assert got == want


def test_long_file_is_cut_without_effect(spark):
    n = 5000
    x = noise(n, 1e-6, 1e-9)
    spikes = [3, 1020, 1023, 1024, 2047, 2048, 4990]
    x[spikes] += 6e-8
    x[1015:1019] = x[1015]
    x[3060:3090] = x[3060]  # over the edge of a block
    x[2040:2041] = x[2040]
    got = flags(spark, series(1, None, None, x), [(1, 0.5, None, "y")])
    assert got == {(k, "i_drain"): "spike" for k in spikes} | {(k, "i_drain"): "stuck" for k in range(3060, 3090)}


def test_whole_block_stuck(spark):
    x = noise(4000, 1e-6, 1e-9)
    x[900:3500] = x[900]
    got = flags(spark, series(1, None, None, x), [(1, 0.5, None, "y")])
    assert set(got) == {(k, "i_drain") for k in range(900, 3500)}


def test_empty(spark):
    assert flags(spark, [], []) == {}
    assert flags(spark, [], [(1, None, None, "y")]) == {}
