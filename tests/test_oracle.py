"""Each query with SQL against DuckDB on the same tables, row by row."""

import datetime
import glob
import os

import duckdb
import pytest

from spanloom.plans.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


#: Queries that SQL does not express: where their functions are tested on literals or against a brute force.
ELSEWHERE = {
    "chunk_documents": "test_chunker", "pending_question": "test_questions", "prose_lines": "test_questions", "secret_values": "test_literals", "literals": "test_literals", "literal_groups": "test_literals",
    "stream_threshold_notice": "test_streams", "breaker_window": "test_streams", "stream_context_notes": "test_sessions",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x + 0.0) if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert name in ELSEWHERE
        return
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in out.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got) == want
