import itertools

import numpy as np
import pytest

from conftest import SF
from spanloom.llm import cross_polytope, hilbert, queries
from test_simhash import plain_components

NAN = float("nan")
ODD = [(900, None), (901, [0.0] * 64), (902, [NAN] * 64), (903, [float("inf")] + [1.0] * 63), (904, []), (905, [None] + [1.0] * 63)]


def clustered(n=700, seed=6):
    """Loose and tight groups, copies, and vectors of unequal norm."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 64))
    rows = []
    for i in range(n):
        v = centre[rng.integers(12)] + rng.normal(size=64) * rng.choice([0.05, 0.25, 0.4, 3])
        rows.append((i, (v / np.linalg.norm(v) * rng.uniform(0.5, 2)).astype(np.float32).tolist()))
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(5, rows[5][1])]
    return rows


def brute_links(rows):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and not any(x is None for x in v) and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    component = plain_components({i for i, _ in rows}, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)))])
    return sorted([(i, int(n), component[i], component[i] == i) for i, n in zip(ids, near.sum(1))] + [(i, 0, i, True) for i, _ in rows if i not in ids])


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, block):
    rows = clustered() + ODD
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, key int")
    got = sorted(tuple(r) for r in cross_polytope.near_vectors(frame, block=block).collect())
    assert got == brute_links(rows)
    assert cross_polytope.near_vectors(frame.where("false")).count() == 0


def test_link_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op1_near_vectors(spark, SF).collect()) == brute_links(rows)


@pytest.mark.parametrize("block", [2048, 2])
def test_ids_of_several_vectors(spark, block):
    x, y = [1.0, 0.0, 0.0, 0.01], [0.0, 1.0, 0.01, 0.0]
    rows = [(1, x), (1, y), (2, [1.0, 0.0, 0.05, 0.0]), (3, [0.05, 1.0, 0.0, 0.0]), (4, y), (0, [0.0, 0.0, 0.0, 1.0])]
    got = sorted(tuple(r) for r in cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_doubles(spark):
    """Near 0.9, below what single precision tells apart."""
    angle = np.arccos(0.9)
    rows = [(0, [1.0, 0.0]), (1, [float(np.cos(angle - 1e-10)), float(np.sin(angle - 1e-10))]), (2, [float(np.cos(angle + 1e-10)), float(-np.sin(angle + 1e-10))])]
    got = sorted(tuple(r) for r in cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]
    best = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in best] == [(0, 1, rows[1][1][0])]


def test_null_id(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in cross_polytope.near_vectors(frame).collect()} == {(None, 0, None, True), (1, 0, 1, True)}


def brute_nearest(rows, k, every):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v and not any(x is None for x in v) and np.isfinite(v).all() and np.any(v)}
    return {q: sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:k] for q in good if q % every == 0}


def recall(rows, got, k=20, every=20):
    want, found = brute_nearest(rows, k, every), {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert found.keys() == want.keys()
    hit = 0
    for q, w in want.items():
        own = found[q]
        assert len(own) == len(w) and own == sorted(own) and all(i != q for _, i in own)
        hit += sum(1 for s, _ in own if s <= w[-1][0] + 1e-9)
    return hit / sum(map(len, want.values()))


def test_search(spark):
    rows = clustered() + ODD
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    assert recall(rows, hilbert.search(frame, block=32).collect()) >= 0.9
    few = frame.where("vec_id < 12")
    assert recall(rows[:12], hilbert.search(few).collect()) == 1
    assert hilbert.search(frame.where("false")).count() == 0


def test_copies_tie_to_smaller_ids(spark):
    v, w = [1.0, 0.0], [0.5, 0.5]
    rows = [(i, v) for i in range(60)] + [(100, w)]
    got = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    found = {(r.query_id, r.rank): r.vec_id for r in got}
    assert [found[40, r] for r in (1, 2, 3)] == [0, 1, 2] and [found[0, r] for r in (1, 2, 3)] == [1, 2, 3]
    assert [found[100, r] for r in (1, 2, 3)] == [0, 1, 2]


def test_rows_that_repeat_an_id_are_one_copy(spark):
    v, w = [1.0, 0.0], [0.5, 0.5]
    rows = [(1, v)] * 30 + [(i, v) for i in (2, 3, 21, 40, 60)] + [(20, w)]
    got = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    found = {(r.query_id, r.rank): r.vec_id for r in got}
    assert found == {(q, r): i for q in (20, 40, 60) for r, i in enumerate((1, 2, 3), 1)}


def test_many_copies_on_narrow_windows(spark):
    rng = np.random.default_rng(9)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same) for i in range(400)] + [(400 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(405, rows[450][1]), (1000, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hilbert.search(frame, k=5, block=16, recall=1.0).collect()
    want = brute_nearest([r for r in rows if r[0] != 405], 5, 20)
    own = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert all(own[q] == [i for _, i in want[q]] for q in want if q < 400 or q == 1000)


def test_search_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(rows, queries.op5_nearest(spark, SF).collect()) >= 0.9


def test_hilbert_curve_steps():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(keys)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_tables_meet_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables = cross_polytope.tables_for(64, 2, 3, 0.9, 0.0005)
    a, b = cross_polytope.buckets(x, tables, 2, 3), cross_polytope.buckets(y, tables, 2, 3)
    assert cross_polytope.met(a, b).any(1).mean() > 0.997
