"""Running totals over many ranges and chains of any shape, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import index, order


def test_running_total_on_many_rows(spark):
    n = 500_000
    rows = spark.range(n, numPartitions=8).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("extra"), F.lit(1).alias("one"))
    placed = index.running_total(index.running_total(rows, [F.col("k").desc()], "one", "place"), [F.col("k").desc()], "v", "total")
    found = placed.agg(F.countDistinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.max("total").alias("sum"), F.count("extra").alias("n")).first()
    assert (found.d, found.lo, found.hi, found.sum, found.n) == (n, 1, n, sum(i % 7 for i in range(n)), n)
    by_key = placed.orderBy(F.col("k").desc()).limit(1000).collect()
    total = 0
    for i, r in enumerate(by_key):
        total += r.v
        assert (r.place, r.total) == (i + 1, total)


def test_surplus_keeps_exactly_that_many(spark):
    cache = spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit(0).alias("seq"), (F.col("id") % 100).cast("double").alias("last_used"), F.lit("t").alias("text"))
    stay = index.gc_surplus(cache, 20_000)
    assert stay.count() == 20_000
    assert stay.agg(F.min("last_used")).first()[0] == 33.0


def followed(edges, most):
    out = {}
    for start in edges:
        seen, at = [start], start
        while len(seen) <= most and at in edges and edges[at] not in seen:
            at = edges[at]
            seen.append(at)
        if len(seen) > 1:
            out[start] = (at, len(seen) - 1)
    return out


@pytest.mark.parametrize("most", [1, 3, 50, 64])
def test_chains_equal_plain_loops(spark, most):
    rng = random.Random(most)
    edges = {i: i + 1 for i in range(100, 161)} | {i: 300 + (i + 1) % 5 for i in range(300, 305)} | {i: i - 1 for i in range(420, 400, -1)} | {400: 410, 500: 500}
    edges |= {i: 600 + rng.randrange(120) for i in range(600, 700)}
    got = order.chain_ends(spark.createDataFrame(list(edges.items()), "parent int, child int"), most)
    assert {r.parent: (r["last"], r.hops) for r in got.collect()} == followed(edges, most)


def test_chain_of_sixty_links_stops_at_fifty(spark):
    got = {r.parent: (r["last"], r.hops) for r in order.chain_ends(spark.range(60).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))).collect()}
    assert got[0] == (50, 50) and got[9] == (59, 50) and got[10] == (60, 50) and got[59] == (60, 1) and len(got) == 60
    assert order.chain_ends(spark.createDataFrame([], "parent long, child long")).collect() == []


def test_nearest_starts_equal_all_pairs(spark, capsys):
    """Ties in time and session, a session's own starts around its exit, borders of slots; exits meet no pairs."""
    import datetime
    import random

    from spanloom.operators.order import handoff_edges

    rng, noon = random.Random(3), datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.timezone.utc)
    made = lambda n: [(rng.choice([0, 1, None]) if rng.random() < 0.1 else rng.randint(0, 1), rng.randint(1, 4), noon + datetime.timedelta(seconds=rng.randint(0, 70))) for _ in range(n)]
    exits, starts = [*made(120), (0, 1, None)], [*made(60), (0, 1, None), (0, None, noon)]
    frame = lambda rows: spark.createDataFrame(rows, "key int, session long, ts timestamp")
    found = handoff_edges(frame(exits), frame(starts), ["key"], 10)
    want = {}
    for k, s, t in exits:
        near = [(abs((t - u).total_seconds()), u, c) for k2, c, u in starts if k is not None and k == k2 and t and u and c not in (None, s) and abs((t - u).total_seconds()) <= 10]
        if near:
            want[k, s, int(t.timestamp() * 1e6)] = (min(near)[2], int(min(near)[0] * 1e6))
    rows = found.collect()
    assert {(r.key, r.parent, r.exit_us): (r.child, r.gap_us) for r in rows} == want and len(rows) == len(want) > 50
    found.explain()
    assert "Join" not in capsys.readouterr().out
