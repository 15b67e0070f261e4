"""Queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same(spark, query, sql, folder=SF):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = query(spark, folder)
    cols = sorted(got.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
