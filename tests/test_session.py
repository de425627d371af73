"""Checkpoints in the shared folder, size-checked joins, and clean-up."""

import os

from ohmgrid import session


def test_materialize_and_discard(spark):
    df = session.materialize(spark.range(5), "numbers")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    path = spark.sparkContext._ohmgrid_written[-1]
    assert path.startswith(session.shared_dir(spark))
    session.discard(spark)
    assert not os.path.exists(path.removeprefix("file://"))


def test_empty_is_readable(spark):
    assert session.materialize(spark.range(0), "none").count() == 0


def test_dimension_beyond_the_bound_is_shuffled(spark, monkeypatch):
    fact, dim = spark.range(100).selectExpr("id % 7 AS k", "id"), spark.range(7).selectExpr("id AS k", "id * 2 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {}
        for limit in (session.BROADCAST_BYTES, 10):
            monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
            j = session.join_dimension(fact, dim, "k")
            assert j.count() == 100
            plans[limit] = j._jdf.queryExecution().toString()
        big, small = plans.values()
        assert "BroadcastHashJoin" in big and "BroadcastHashJoin" not in small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
