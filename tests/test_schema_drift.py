"""p1: each kind of change, notations that are no change, and the consistent table."""

import datetime

from ohmgrid.operators import schema_drift as sd

FILES = "id int, experiment string, measurement_category string, measured_on date, columns string, measurement_type string, cells string"
DAY = [datetime.date(2020, 1, d) for d in range(1, 9)]


def tables(spark, files, samples):
    f = spark.createDataFrame([(i, "E", "C", d, c, t, "clash") for i, d, c, t in files], FILES)
    s = spark.createDataFrame([(i, n, c, "clash") for i, n, c in samples], "metadata_id int, row_no int, cells string, experiment string")
    n = spark.createDataFrame([("V_Gate", "v_gate"), ("Vgs", "v_gate"), ("I_Drain", "i_drain"), ("T", "time_val"), (None, "x")], "header_base string, field_name string")
    return f, s, n


def changes(spark, files, samples=()):
    return sorted((r.measured_on[-1], r.field_name, r.change) for r in sd.changes(*tables(spark, files, list(samples))).collect())


def test_added_removed_renamed(spark):
    files = [(1, DAY[0], "V_Gate,I_Drain", None), (2, DAY[1], "vgs;T", None), (3, DAY[2], "VGS\tt", None)]
    assert changes(spark, files) == [("2", "i_drain", "removed"), ("2", "time_val", "added"), ("2", "v_gate", "renamed")]


def test_notation_is_no_change(spark):
    files = [(1, DAY[0], "V_Gate(1),I_Drain(1),V_Gate(2),I_Drain(2)", None), (2, DAY[1], " i drain [A] | V Gate[V]", None), (3, DAY[2], None, None), (4, DAY[3], "v_gate,i_drain", None)]
    assert changes(spark, files) == []


def test_type_change_needs_cells_on_both_dates(spark):
    files = [(1, DAY[0], "V_Gate;I_Drain", None), (2, DAY[1], "V_Gate;I_Drain", None), (3, DAY[2], "V_Gate;I_Drain", None)]
    samples = [(1, 0, "1.5;2.0e-3"), (2, 0, "1,5;"), (2, 1, ";"), (3, 0, "2.5;~1.0"), (3, 1, "broken")]
    assert changes(spark, files, samples) == [("2", "v_gate", "type_changed"), ("3", "v_gate", "type_changed")]


def test_measurement_type_skips_nulls(spark):
    files = [(1, DAY[0], None, "Id-Vg"), (2, DAY[1], None, None), (3, DAY[2], None, "ID_VG"), (4, DAY[3], None, "IdVg_dc")]
    assert changes(spark, files) == [("4", "measurement_type", "renamed")]


def test_null_keys_unknown_bases_and_empty(spark):
    f, s, n = tables(spark, [(1, None, "V_Gate", "a"), (2, DAY[0], "Foo,V_Gate", "a"), (3, DAY[1], "V_Gate", "a")], [])
    assert [(r.field_name, r.change) for r in sd.changes(f, s, n).collect()] == [("foo", "removed")]
    assert sd.changes(f.limit(0), s, n).count() == 0
    assert sd.versions(f, s, n).count() == 2
    assert sd.consistent_table(f.limit(0), s, n.limit(0)).count() == 0


def test_consistent_table(spark):
    files = [(1, DAY[0], "Vgs(1),I_Drain(1),Vgs(2),I_Drain(2)", None), (2, DAY[0], "T;V_Gate", None)]
    rows = sd.consistent_table(*tables(spark, files, [(1, 0, "1.0,2.0 A,3.0,"), (2, 0, "<1,5e+01;x")])).collect()
    got = {(r.metadata_id, r.step): r for r in rows}
    assert (got[1, 1].v_gate, got[1, 1].i_drain, got[1, 2].v_gate, got[1, 2].i_drain) == (1.0, 2.0, 3.0, None)
    assert got[2, 1].time_val == 15.0 and got[2, 1].v_gate is None
    assert "rename vgs > v_gate" in got[1, 1].rules and "cast i_drain" in got[1, 1].rules and "default time_val" in got[1, 1].rules


def test_steps_are_chained_from_version_to_version(spark):
    files = [(1, DAY[0], "Vgs", None), (2, DAY[1], "V_Gate,I_Drain", None), (3, DAY[2], "V_Gate,I_Drain", None), (4, DAY[3], "Vgs,I_Drain", None), (5, None, "Vgs", None)]
    f, s, n = tables(spark, files, [(i, 0, c) for i, c in [(1, "1"), (2, "2,3"), (4, "4,5"), (5, "6")]])
    rules = {r.metadata_id: r.rules.split("; ") for r in sd.consistent_table(f, s, n).collect()}
    day = lambda k: DAY[k].isoformat()
    assert rules[1] == [f"rename vgs > v_gate @ {day(1)}", f"rename v_gate > vgs @ {day(3)}", "rename vgs > v_gate", "default i_drain", "default time_val", "default x"]
    assert rules[2] == [f"rename v_gate > vgs @ {day(3)}", "rename vgs > v_gate", "default time_val", "default x"]
    assert rules[4] == ["rename vgs > v_gate", "default time_val", "default x"] and rules[5] == ["rename vgs > v_gate", "default i_drain", "default time_val", "default x"]
    v = sd.fingerprints(f, s, n)
    assert {(r.version, r.change) for r in sd.steps(v).collect()} == {(2, "renamed"), (2, "added"), (4, "renamed")}  # version 3 has the fingerprint of 2
