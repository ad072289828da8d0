"""Every registered query of the library against DuckDB on the driver's smallest tables; those without SQL must give rows."""

import glob
import os

import duckdb
import pytest

from storyloom import catalog

DATA = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(rows, columns):
    def one(x):
        if x is None or x != x:
            return "~"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return f"{float(x):.8g}"
        return str(x)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in found.collect()]
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert columns == sorted(found.columns)
    assert normal(rows, columns) == normal([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
