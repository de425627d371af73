"""p2: notations of one quantity, units in notes, placeholders, and the weighted distance."""

import pytest

from ohmgrid.operators import units

SCHEMA = "id long, voltage_rating string, rdson_mohm string, current_rating_a string, notes string, raw string, unit string"


def base(spark, v, r, a, notes=None):
    df = spark.createDataFrame([(1, v, r, a, notes, "clash", "clash")], SCHEMA)
    got = {x.field_name: x.value_base for x in units.in_base_units(units.ratings(df, "t", "id")).collect()}
    return tuple(got.get(f) for f in units.FIELDS)


@pytest.mark.parametrize("v, r, a, want", [
    ("1200", "80", "20", (1_200_000, 80_000, 20_000)),
    ("1.2kV", "80 mΩ", "20A", (1_200_000, 80_000, 20_000)),
    ("1,200 V", "0,08 Ohm", "20,000 mA", (1_200_000, 80_000, 20_000)),
    ("1 200 000 mV", "80 000 µΩ", "0.02 kA", (1_200_000, 80_000, 20_000)),
    ("1,200,000 mV", "8.0e-02 ohms", "2e+01 Adc", (1_200_000, 80_000, 20_000)),
    ("rated 1200 volts @ 25 °C", "typ. 0.08R", "ca. 20 amps (Tj = 150 C)", (1_200_000, 80_000, 20_000)),
    ("max 1.2 KV at 100°C case", "80 milliohm", " 20 A ", (1_200_000, 80_000, 20_000)),
    ("n/a", "-", "?", (None, None, None)),
    ("", None, "TBD", (None, None, None)),
])
def test_notations(spark, v, r, a, want):
    assert base(spark, v, r, a) == want


def test_notes_hold_for_bare_numbers_only(spark):
    said = "Voltage in kilovolts / Rds(on) listed in micro-ohm, If stated in kA; needs new 20 A fuse"
    assert base(spark, "1.2", "80000", "0.02", said) == (1_200_000, 80_000, 20_000)
    assert base(spark, "1200 V", "80 mOhm", "20 A", said) == (1_200_000, 80_000, 20_000)
    assert base(spark, "1200", "80", "20", "Vth shift seen at 175 C, needs new 20 A fuse.") == (1_200_000, 80_000, 20_000)


def aliases(spark, field, spelled):
    found = spark.createDataFrame([(field, x) for x in spelled], "field_name string, spelling string")
    return {r.spelling: r.factor for r in units.alias_dictionary(found).collect()}


def edits(name):
    """name with one letter dropped, changed (not the first), doubled, or swapped with the next."""
    n = range(len(name))
    return {name[:i] + name[i + 1 :] for i in n} | {name[:i] + "x" + name[i + 1 :] for i in n[1:]} | {name[:i] + name[i] + name[i:] for i in n[1:]} | {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in n[:-1]}


@pytest.mark.parametrize("field", units.FIELDS)
def test_misspelled_names(spark, field):
    own = {n: x for f, n, x in units.UNITS if f == field}
    planted = {e: x for n, x in own.items() if len(n) >= 5 for e in edits(n) if e not in own}
    got = aliases(spark, field, {*planted, *own})
    assert {n: got.get(n) for n in own} == own
    wrong = {e: (got[e], x) for e, x in planted.items() if e in got and got[e] != x}
    missed = {e for e in planted if e not in got}
    assert not wrong and all(len(e) <= 7 for e in missed), (wrong, missed)  # short ones between two scales are refused


def test_scales_never_cross(spark):
    assert aliases(spark, "voltage_rating", ["nanovolt", "megavolt", "nvolt", "gv", "furlong", "killivolt", "picovolt"]) == {}
    assert aliases(spark, "rdson_mohm", ["nohm", "gohm", "megaohm"]) == {}
    assert aliases(spark, "voltage_rating", ["milivolt", "mikrovolt", "kvolts", "vdc"]) == {"milivolt": 1.0, "mikrovolt": 1e-3, "kvolts": 1e6, "vdc": 1e3}


def test_unknown_units_are_reported(spark):
    assert base(spark, "1200 milivolt", "3 furlong", "20 milliampre") == (1200, None, 20)
    assert base(spark, "1200 max", "80", "20", "current in parsec") == (1_200_000, 80_000, None)
    df = spark.createDataFrame([(1, "1200 milivolt", "3 furlong", "20", "current in parsec", "", "")], SCHEMA)
    got = {(r.field_name, r.spelling) for r in units.unmatched(units.ratings(df, "t", "id")).collect()}
    assert got == {("rdson_mohm", "furlong"), ("current_rating_a", "parsec")}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "5 V", None, None, None, "", "")] * 3, SCHEMA)
    assert units.in_base_units(units.ratings(df, "t", "id")).count() == 3
    assert units.in_base_units(units.ratings(df.limit(0), "t", "id")).count() == 0
