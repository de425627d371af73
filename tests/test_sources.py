"""Parsers, listings, sinks and binary files on small files."""

from pyspark.sql import functions as F

from ohmgrid.plans import laboratory
from ohmgrid.sources import binary_files, listing, sinks, text_files

DATA = "/root/testdata/sf0.001"


def texts(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


def test_curve_csv(spark):
    got = text_files.curve_csv(texts(spark, "GROUP 1\nV_Drain(1),I_Drain(1),V_Drain(2),I_Drain(2)\n1,2,3,4\n,,,\nx,1e-3,NaN,\n1,2\n", "Vgs [V],Ids [A]\r\n5,6\r\n", "", "only")).collect()
    behind = text_files.curve_csv(texts(spark, "V_Drain,I_Drain\nGROUP 1,7\n1,2\n")).collect()
    assert [(r.v_drain, r.i_drain) for r in behind] == [(1.0, 2.0)]
    rows = {(r.path, r.row_no, r.step): (r.v_gate, r.v_drain, r.i_drain) for r in got}
    assert rows == {("f0", 0, 1): (None, 1.0, 2.0), ("f0", 0, 2): (None, 3.0, 4.0), ("f0", 2, 1): (None, None, 1e-3), ("f1", 0, 1): (5.0, None, 6.0)}


def test_curve_csv_of_every_separator(spark):
    files = ["V_Gate(1){0}I_Drain(1) [A]{0}V_Gate(2){0}I_Drain(2) [A]\n1{0}2{0}3{0}4\n{0}{0}5{0}\n".format(by) for by in (",", ";", "|", "\t")]
    got = text_files.curve_csv(texts(spark, *files), separator=None).collect()
    rows = {(r.path, r.row_no, r.step): (r.v_gate, r.i_drain) for r in got}
    assert rows == {(f"f{i}", *k): v for i in range(4) for k, v in {(0, 1): (1.0, 2.0), (0, 2): (3.0, 4.0), (1, 2): (5.0, None)}.items()}
    files = laboratory.query.queries["src_curve_csv_all"](spark, DATA)
    heads = spark.read.parquet(f"{DATA}/baselines_metadata.parquet").select(F.col("id").cast("string").alias("path"), "columns")
    seen = files.join(heads, "path").select("step", F.regexp_extract("columns", "[;|\t]", 0).alias("by")).distinct().collect()
    assert {r.by for r in seen} >= {"", "|"} and max(r.step for r in seen) > 1


def test_other_layouts(spark):
    two = text_files.two_header_csv(texts(spark, "CH1,CH2\nV_Gate,I_Gate\n1,2\n3,4\n")).collect()
    assert sorted((r.v_gate, r.i_gate) for r in two) == [(1.0, 2.0), (3.0, 4.0)]
    scope = text_files.scope_csv(texts(spark, "t,v,i,g\n0,1,2,3\n1e-6;2;3;4\nbad\n")).collect()
    assert [(r.time_val, r.v_drain) for r in scope] == [(0.0, 1.0), (1e-6, 2.0)]
    head, t7, t5 = "Time\tVds\tIds\tVgs\tIgs\tarduino_ms\tfluence", "1\t2\t3\t4\t5\t6\t7", "2\t3\t4\t5\t6"
    want = [(1.0, 2.0, 3.0, 4.0, 5.0, 7.0), (2.0, 3.0, 4.0, None, None, 6.0)]
    for first in (f"{head}\n", ""):
        mon = text_files.monitor_txt(texts(spark, f"Facility = North\n{first}{t7}\n{t5}\n")).collect()
        assert [(r.time_val, r.v_drain, r.i_drain, r.v_gate, r.i_gate, r.fluence) for r in mon] == want
    turned = text_files.monitor_txt(texts(spark, "t\tVg\tIg\tVd\tId\tarduino_ms\tfluence_cm2\n1\t2\t3\t4\t5\t6\t7\n")).first()
    assert (turned.v_gate, turned.i_drain, turned.fluence) == (2.0, 5.0, 7.0)
    assert [(r.key, r.value) for r in text_files.settings(texts(spark, "Facility = North\nrun: 5 \n\n1\t2")).collect()] == [("Facility", "North"), ("run", "5")]


def test_scripts(spark):
    r = text_files.script_parameters(texts(spark, "smu1.source.limiti = 0.1\nsmu1.measure.nplc=10\nSweepVLinMeasureI(smu1, -5, 20, 0.1, 51)\ndelay(0.5)\n", "nothing")).orderBy("path").collect()
    assert (r[0].compliance, r[0].plc, r[0].delay, r[0].sweep_start, r[0].sweep_stop, r[0].sweep_points) == (0.1, 10.0, 0.5, -5.0, 20.0, 51.0)
    assert r[1].compliance is None


def test_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("V_Gate\n1\n")
    (tmp_path / "a" / "y.txt").write_text("z")
    (tmp_path / "w.h5").write_bytes(b"not one")
    files = text_files.read_texts(spark, str(tmp_path), "*.csv")
    assert text_files.curve_csv(files).count() == 1
    assert listing.crawl(spark, str(tmp_path), ("csv", "txt"), exclude=("y.",)).count() == 1
    sheets = tmp_path / "s"
    sheets.mkdir()
    (sheets / "w.xls").write_bytes(b"no sheet")
    assert binary_files.waveforms(spark, str(sheets)).filter("skipped IS NOT NULL").count() == 1


def test_companions_and_remap(spark):
    f = spark.createDataFrame([("/a/b/c/x.csv",), ("/a/q.csv",), ("/n.csv",)], "path string")
    there = spark.createDataFrame([("/a/lib/x.tsp",), ("/a/b/lib/x.tsp",), ("/a/q.tsp",)], "path string")
    assert {tuple(r) for r in listing.companions(f, there, "path", "tsp").collect()} == {("/a/b/c/x.csv", "/a/b/lib/x.tsp")}  # folders `lib` only
    assert {tuple(r) for r in listing.companions(f, there, "path", "tsp", folder=None).collect()} == {("/a/q.csv", "/a/q.tsp")}
    f = spark.createDataFrame([("/a/b/1_x_append2.csv",), ("/a/b/x_append.csv",), ("/a/b/2_y.csv",), ("/1/2/3/4/5/6/x.csv",)], "path string")
    there = spark.createDataFrame([("/a/b/lib/x.tsp",), ("/a/b/lib/1_x.tsp",), ("/a/lib/2_y.tsp",), ("/a/b/lib/y.tsp",), ("/1/lib/x.tsp",)], "path string")
    got = {tuple(r) for r in listing.companions(f, there, "path", "tsp").collect()}
    assert got == {("/a/b/1_x_append2.csv", "/a/b/lib/1_x.tsp"), ("/a/b/x_append.csv", "/a/b/lib/x.tsp"), ("/a/b/2_y.csv", "/a/lib/2_y.tsp")}
    old = spark.createDataFrame([(1, "p1", "h1", "a"), (2, "p2", "h2", "b"), (3, None, None, "c")], "id int, path string, hash string, v string")
    new = spark.createDataFrame([("p1", "h9", "A"), ("p9", "h2", "B")], "path string, hash string, v string")
    assert {r.id: (r.v, r.changed) for r in listing.remapped(old, new, "path", "hash", "v").collect()} == {1: ("A", True), 2: ("B", True), 3: ("c", False)}


def test_changes_of_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "N"), (3, "c")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (None, "N"), (3, "c")}
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"], update=False).collect()} == {(1, "a"), (2, "b"), (None, "n"), (3, "c")}
    assert {tuple(r) for r in sinks.update_from(old, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, "B"), (None, "n")}
    assert {tuple(r) for r in sinks.delete_using(old, new, ["k"]).collect()} == {(1, "a"), (None, "n")}
    sinks.append(old, str(tmp_path / "t"), ["v"])
    sinks.append(new, str(tmp_path / "t"), ["v"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    arr = spark.createDataFrame([(1, ["x", "y"], None)], "k int, a array<string>, n double")
    sinks.export_csv(arr, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()] == [("1", "x; y", None)]


def test_reconcile(spark):
    s = "k int, a string, b double"
    there = spark.createDataFrame([(1, "x", 1.0), (2, "", 2.0), (3, "z", 3.0)], s)
    seed = spark.createDataFrame([(1, "x", 1.0 + 1e-12), (2, "y", 2.5), (3, "q", None), (4, "n", 4.0)], s)
    got = {(r.k, r.field): r.action for r in sinks.reconcile(there, seed, ["k"], ["a", "b"], owned=("b",)).collect()}
    assert got == {(1, "a"): "noop", (1, "b"): "noop", (2, "a"): "fill_blank", (2, "b"): "code_update", (3, "a"): "conflict", (3, "b"): "noop", (4, "a"): "insert", (4, "b"): "insert"}
