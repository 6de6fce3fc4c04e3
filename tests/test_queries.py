"""Every library query against its SQL on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalog import queries as library

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", library.QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(library.SQL[name])
    columns = [d[0] for d in want.description]
    got = library.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_contract(spark):
    assert set(library.QUERIES) == set(library.SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["path", "pos", "raw", "name", "constraint"]
