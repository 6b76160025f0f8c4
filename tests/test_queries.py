"""Every core query runs over the smallest tables and says what its SQL says."""

import glob
import os

import pytest

from glossmill import registry
from glossmill.plans.shared import let_workers_import

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(text, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    let_workers_import(spark)
    got = rows(QUERIES[name](spark, data).toPandas())
    if name in SQL:
        assert got == rows(duck.execute(SQL[name]).df())
    else:
        assert got[1]


def test_names_match():
    assert set(SQL) <= set(QUERIES)
