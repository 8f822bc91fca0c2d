"""Queries of this subpackage with SQL, against DuckDB on the same tables, row by row."""

import math

import duckdb
import pytest

from conftest import SF
from spanloom.llm import cross_polytope
from spanloom.llm.queries import QUERIES, SQL


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("name,tables", [("op1_near_vectors", ["embeddings"]), ("op7_warc", ["pages"])])
def test_tables(spark, name, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    out = con.execute(SQL[name])
    names = [c[0] for c in out.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    wanted = sorted(out.fetchall(), key=str)
    assert wanted and rows_of(df, names) == wanted


def test_vectors_that_link_with_nothing(spark):
    """Null, zero, null components, not finite; repeated rows and a chain."""
    turn = [[math.cos(k * 0.4), math.sin(k * 0.4), 0.0, 0.0] for k in range(4)]
    rows = [(1, None), (2, [0.0] * 4), (3, [1.0, None, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0, 0.0]), (9, turn[0]), (8, turn[1]), (7, turn[2]), (6, turn[3]), (10, turn[0]), (11, [0.0, 0.0, 1.0, 0.0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    names = ["vec_id", "n_links", "component_id", "kept"]
    wanted = sorted(con.sql(f"select {', '.join(names)} from ({SQL['op1_near_vectors']})").fetchall())
    assert wanted[4] == (6, 1, 6, True) and wanted[7] == (9, 2, 6, False)
    found = cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(rows_of(found, names)) == wanted
