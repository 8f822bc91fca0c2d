"""Streaming decisions against plain loops over the same rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.plans import sessions
from spanloom.plans.tables import events
from spanloom.streaming import states

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own(spark):
    """Events of each user in order of time."""
    rows = events(spark, SF).select(F.col("user_id").cast("string").alias("key"), "ts", "event_id", F.floor("value").cast("long").alias("n")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        found.setdefault(r.key, []).append(r)
    return found


def test_breaker(spark, own):
    want = []
    for key, rows in own.items():
        first = None
        for r in rows:
            blocked = first is None or (r.ts - first).total_seconds() > 3600
            first = r.ts if blocked else first
            want.append((key, r.ts, blocked))
    assert sorted(map(tuple, sessions.breaker_window(spark, SF).collect())) == sorted(want)


def test_notices(spark, own):
    want = []
    for key, rows in own.items():
        told, last = 0, 0
        for r in rows:
            tokens = r.n * 1000
            now = sum(tokens >= least for _, least in states.LEVELS)
            if not now:
                told = last = 0
            elif now > told or now == 3 or tokens >= last + 20_000:
                told, last = now, tokens
                want.append((key, r.ts, ["soft", "hand", "hard"][now - 1], tokens))
    assert sorted(map(tuple, sessions.stream_threshold_notice(spark, SF).collect())) == sorted(want)


def streamed(spark, tmp_path, rows, schema, processed):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states.drain(processed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


NOON = datetime(2024, 1, 1, 12)


def test_handoffs(spark, tmp_path):
    rows = [("p", NOON, "a", True), ("p", NOON + timedelta(hours=1), "b", False), ("p", NOON + timedelta(hours=2), "c", False)]
    rows += [("q", NOON, "a", True), ("q", NOON + timedelta(hours=1), "a", False), ("q", NOON + timedelta(hours=2), "b", False)]
    rows += [("r", NOON, "a", True), ("r", NOON + timedelta(hours=13), "b", False)]
    got = streamed(spark, tmp_path, rows, "key string, at timestamp, session string, sets boolean", states.handoffs)
    assert got == [("p", NOON + timedelta(hours=1), "a", "b")]


def test_show_once(spark, tmp_path):
    rows = [("s", NOON, "x"), ("s", NOON + timedelta(minutes=1), "x"), ("s", NOON, "y"), ("t", NOON, "x")]
    got = streamed(spark, tmp_path, rows, "key string, at timestamp, mark string", lambda s: states.show_once(s, ["key", "mark"]))
    assert sorted((k, m) for k, _, m in got) == [("s", "x"), ("s", "y"), ("t", "x")]
