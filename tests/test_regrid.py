"""p7: gaps, pauses, boundaries and interpolation on small series."""

from ohmgrid.operators import regrid

POINTS = "id long, metadata_id int, time_val double, v_gate double, i_gate double, v_drain double, i_drain double, slot string"
FILES = "id int, delay_time double, slot string"


def tables(spark, times, delay=1.0, values=None):
    rows = [(k, 1, t, *([None if values is None else values[k]] * 4), "x") for k, t in enumerate(times)]
    return spark.createDataFrame(rows, POINTS), spark.createDataFrame([(1, delay, "y"), (2, None, "y"), (3, 0.0, "y")], FILES)


def missing(spark, times, delay=1.0):
    return sorted(r.slot for r in regrid.missing_slots(*tables(spark, times, delay)).collect())


def test_gaps_and_pause(spark):
    assert missing(spark, [0.2, 1.5, 4.1, 5.0]) == [2, 3]
    assert missing(spark, [0.0, 101.0]) == list(range(1, 101))
    assert missing(spark, [0.0, 102.0]) == []
    assert missing(spark, [3.0]) == []


def test_order_repeats_nulls_and_overflow(spark):
    assert missing(spark, [5.0, 1.0, None, 1.0, 9.9e37, float("nan"), float("inf"), 3.0]) == [2, 4]
    assert missing(spark, [-2.5, 0.5]) == [-2, -1]


def test_over_spans(spark):
    times = [4094.0, 4098.0, 8191.0, 8193.0, 12290.0]
    assert missing(spark, times) == [4095, 4096, 4097, 8192]
    long = [float(k) for k in range(9000) if k % 7 != 3]
    assert missing(spark, long) == [k for k in range(9000) if k % 7 == 3]


def test_grid_is_regular_and_filled(spark):
    p, f = tables(spark, [0.5, 1.0, 3.0, 200.0, 201.0], values=[0.0, 1.0, 3.0, 9.0, None])
    got = {r.slot: r for r in regrid.regular_series(p, f).collect()}
    assert sorted(got) == list(range(202))
    assert [got[k].status for k in (0, 1, 2, 3, 4, 199, 200, 201)] == ["read", "read", "filled", "read", "pause", "pause", "read", "read"]
    assert got[2].v_gate == 2.0 and got[4].v_gate is None and got[201].v_gate is None


def test_long_pause_is_whole(spark):
    p, f = tables(spark, [0.0, 25_000.0])
    assert regrid.regular_series(p, f).count() == 25_001


def test_grid_is_extended_to_bounds(spark):
    p, f = tables(spark, [2.0, 3.0])
    def status(first, last):
        b = spark.createDataFrame([(1, first, last), (99, 0, 5)], "metadata_id int, first_slot int, last_slot int")
        return {r.slot: r.status for r in regrid.regular_series(p, f, b).collect()}
    assert status(0, 5) == {0: "before", 1: "before", 2: "read", 3: "read", 4: "after", 5: "after"}
    assert status(3, 2) == status(None, None) == {2: "read", 3: "read"}
    assert len(status(0, 25_000)) == 25_001


def test_files_without_grid_and_empty(spark):
    p, f = tables(spark, [0.0, 5.0])
    assert regrid.missing_slots(p, f.filter("id > 1")).count() == 0
    assert regrid.missing_slots(p.limit(0), f).count() == 0
    assert regrid.regular_series(p.limit(0), f.limit(0)).count() == 0
