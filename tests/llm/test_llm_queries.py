"""The registered queries over the smallest tables, against their SQL where there is some."""

import glob
import os

import pytest

from glossmill.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name[:2] in ("p7", "p8") and not os.path.exists("/opt/tokenizers"):
        pytest.skip("no vocabulary files here")
    frame = QUERIES[name](spark, data).toPandas()
    assert len(frame) or name in ("p5_found",)
    if name.endswith("_found"):
        assert not frame.duplicated().any()
    if name in SQL:
        import duckdb

        con = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        other = con.execute(SQL[name]).df()
        cols = sorted(frame.columns)
        assert cols == sorted(other.columns)
        rows = lambda f: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in f[cols].itertuples(index=False))
        assert rows(frame) == rows(other)
