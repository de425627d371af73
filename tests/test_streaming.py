"""The same windows on a batch and on a stream."""

from ohmgrid.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    src.orderBy("ts").repartitionByRange(3, "ts").write.parquet(folder)
    s = events.tumbling(events.read_folder(spark, folder, src.schema, 1), "1 hour", late="1 day")
    q = events.start(s, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {(r.event_type, r.begin): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.event_type, r.begin): r.n for r in events.tumbling(src, "1 hour").collect()}
    assert got and all(want[k] == n for k, n in got.items())  # windows the watermark has closed


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 01:00:00"), (2, None)]
    e = spark.createDataFrame(rows, "user_id int, ts string").selectExpr("user_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts")
    assert sorted(r.n for r in events.sessions(e, "30 minutes").collect()) == [1, 2]
