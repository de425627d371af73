"""p3: notations of one file, different files, carried links, and arrivals one after another."""

from ohmgrid.llm import batch_dedup as bd
from ohmgrid.llm.components import components

SCHEMA = "id int, ingest_batch int, csv_path string, file_hash string, num_points int, numbers string, words string, hash string"
PATH = "/srv/lab/Amberfield_ageing_2024_000020/20190124_pre/W05_C38/W05_C38_IdVd_rev_50V_001.csv"


def frame(spark, rows):
    return spark.createDataFrame([(i, b, p, h, n, "clash", "clash", "clash") for i, b, p, h, n in rows], SCHEMA)


def repeats(spark, rows, loads=None):
    return {(r.id_a, r.id_b) for r in bd.accept_all(frame(spark, rows), loads=loads).repeats().collect()}


def test_spellings_of_one_path(spark):
    same = [
        PATH, PATH.upper(), PATH.replace("/", "\\").replace("\\srv\\lab", "N:\\curves"), PATH.replace("_", "-"), PATH.replace("_", " "), PATH.replace("Amberfield", "Ambrefield"),
        PATH.replace("/20190124", "/restored/20190124"), PATH + ".bak", PATH.replace(".csv", " (2).csv"), PATH.replace(".csv", "_copy.csv.tmp"), PATH.replace("_", "%5F"), PATH.replace("W05_C38/", "W05_C38//old/"),
    ]
    assert repeats(spark, [(i, i % 3, p, None, 5) for i, p in enumerate(same, 1)]) == {(1, i) for i in range(2, len(same) + 1)}


def test_different_files(spark):
    other = [
        PATH, PATH.replace("000020", "000021"), PATH.replace("20190124", "20190125"), PATH.replace("_pre", "_post"), PATH.replace("W05", "W06"), PATH.replace("C38", "C39"),
        PATH.replace("IdVd", "IdVg"), PATH.replace("rev", "fwd"), PATH.replace("50V", "5V"), PATH.replace("_001", "_002"), PATH.replace("Amberfield_ageing", "Kingsmoor_stress"),
    ]
    assert repeats(spark, [(i, 0, p, None, 5) for i, p in enumerate(other, 1)]) == set()


def test_hashes_carry_over_paths(spark):
    h = "1b7675f28c6b6d4476399ad82a2b520c"
    rows = [(5, 0, PATH, h, 5), (2, 1, "/x/incoming/scan_00000001.csv", "md5:" + h.upper() + " ", 5), (9, 2, "/y/scan_00000001.csv.bak", None, 5), (7, 2, None, h, 5)]
    assert repeats(spark, rows) == {(2, 5), (2, 7), (2, 9)}


def test_no_evidence(spark):
    rows = [(1, 0, PATH, None, 0), (2, 0, PATH, None, 5), (3, 1, None, bd.EMPTY_HASH, 5), (4, 1, None, bd.EMPTY_HASH, 5), (5, 1, "", "xyz", 5), (6, 1, "", "xyz", None), (7, None, None, None, None)]
    assert repeats(spark, rows) == set()


def test_arrivals_make_no_difference(spark):
    rows = lambda k: [(i, i % k, PATH.replace("_001", f"_{i % 11:03d}").replace("Amber", "Ambre" if i % 2 else "Amber"), f"{i % 13:032x}" if i % 3 == 0 else None, 1) for i in range(1, 120)]
    want = {(1, i) for i in range(2, 120)}
    assert repeats(spark, rows(1)) == want
    assert repeats(spark, rows(5)) == want
    assert repeats(spark, rows(5), loads=2) == want


def test_components_that_meet_later(spark, monkeypatch):
    """Two files turn out to be one when a third row has the path of one and the hash of the other; a late row is first."""
    h, other = "1b7675f28c6b6d4476399ad82a2b520c", PATH.replace("W05_C38_IdVd", "W09_C38_IdVd")
    rows = [(10, 0, PATH, None, 5), (11, 1, PATH, None, 5), (12, 1, other, h, 5), (13, 2, other, None, 5), (14, 3, PATH, h, 5), (5, 4, PATH.upper(), None, 5)]
    want = {(5, i) for i in range(10, 15)}
    assert repeats(spark, rows) == want
    monkeypatch.setattr(bd, "LOCAL_LINKS", -1)  # the form for large batches
    monkeypatch.setattr(bd, "BROADCAST_BYTES", -1)
    assert repeats(spark, rows) == want


def test_store_is_appended_to_and_opened_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bd, "MERGE", 3)
    path = f"file://{tmp_path}/store"
    rows = [(i, i % 8, PATH.replace("_001", f"_{i % 40:03d}"), None, 1) for i in range(1, 121)]
    store = bd.accept_all(frame(spark, [r for r in rows if r[1] < 5]), path)
    assert sum(1 for n in store.loads["paths"] if len(set(n.split("-"))) == 1) < 3
    before = {tuple(r) for r in store.read("paths").collect()}
    again = bd.Store(spark, path)
    assert again.loads == store.loads
    for k in (5, 6, 7):
        bd.accept(bd.keyed(frame(spark, [r for r in rows if r[1] == k])), again)
    assert before <= {tuple(r) for r in again.read("paths").collect()}
    assert again.read("paths").count() == 40
    assert {(r.id_a, r.id_b) for r in again.repeats().collect()} == {((i - 1) % 40 + 1, i) for i in range(41, 121)}


def test_touched_ranges_only(spark):
    """A batch reads the stored rows of its own days."""
    days = [(i, 0, PATH.replace("20190124", f"2019{m:02d}24"), None, 5) for i, m in enumerate(range(1, 13), 1)]
    store = bd.accept_all(frame(spark, days))
    own = bd.pivoted(bd.keyed(frame(spark, [(99, 1, PATH, None, 5)]))).first()
    assert store.near([(own.d0, own.d0)]).count() == 1
    assert "PushedFilters: [IsNotNull(d0)" in store.near([(own.d0, own.d0)])._jdf.queryExecution().toString()


def test_hot_group(spark):
    rows = [(i, i % 4, PATH, "a" * 32, 1) for i in range(1, 500)]
    assert repeats(spark, rows) == {(1, i) for i in range(2, 500)}


def test_empty(spark):
    assert repeats(spark, []) == set()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (101, 103), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)} | {i: 200 for i in range(200, 241)}
