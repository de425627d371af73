"""Every registered query runs on the smallest scale, and equals its SQL where there is one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def folded(pdf):
    cell = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(cell(number(v)) for v in row) for row in pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False))


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns)
    if name not in SQL:
        got.count()
        return
    assert folded(got.toPandas()) == folded(duck.sql(SQL[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).schema
