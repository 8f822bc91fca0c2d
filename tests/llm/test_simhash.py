import itertools
import re

import numpy as np
import pytest
import xxhash

from conftest import HARD_TEXTS, SF
from spanloom.llm import queries, simhash
from spanloom.llm.components import connected_components


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def brute(docs):
    fps = {}
    for doc_id, text in docs:
        fps.setdefault(doc_id, plain_fingerprint(text))
    pairs = [(a, b) for a, b in itertools.combinations([x for x in fps if x is not None], 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    return fps, plain_components([x for x in fps if x is not None], pairs)


def check(rows, docs):
    fps, component = brute(docs)
    got = [(r[0], r[1], r[2]) for r in rows if r[0] is not None]
    assert sorted(got) == sorted((d, f"{fps[d]:016x}", component[d]) for d, _ in docs if d is not None)


def test_query(spark):
    check(queries.op8_simhash(spark, SF).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


@pytest.mark.parametrize("crowd", [2000, 1])
def test_hard_and_empty(spark, hard_docs, no_docs, crowd):
    found = simhash.near_duplicates(hard_docs, crowd).select("doc_id", simhash.hex_of(), "component_id").collect()
    assert len(found) == len(HARD_TEXTS)
    check(found, HARD_TEXTS)
    assert simhash.near_duplicates(no_docs, crowd).count() == 0


def test_anchors_join_all_near_words():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for _ in range(4):
        flips = np.zeros(300, dtype=np.uint64)
        for bits in rng.integers(0, 64, (2, 300)):
            flips ^= np.uint64(1) << bits.astype(np.uint64)
        (a, of_a), (b, of_b) = simhash.anchors(fp), simhash.anchors(fp ^ flips)
        assert np.bincount(of_a).max() <= 32
        for i in range(300):
            assert set(a[of_a == i]) & set(b[of_b == i])


@pytest.mark.parametrize("crowd", [2000, 3])
def test_links_against_brute_force(spark, crowd):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(15):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    rows = [(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    links = simhash.anchor_links(classes, crowd).collect()
    crowded = spark.createDataFrame([(r.fp, r.u) for r in links if r.v is None], "fp long, rep long").distinct()
    edges = [(r.u, r.v) for r in links if r.v is not None] + [(r.u, r.v) for r in simhash.crowd_links(crowded).collect()]
    want = plain_components(range(len(fps)), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert plain_components(range(len(fps)), edges) == want


def test_components(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(200, 300)]
    pairs = chain + [tuple(map(int, p)) for p in rng.integers(0, 150, (70, 2))] + [(7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()}
    want = plain_components({x for p in pairs for x in p}, pairs)
    assert {n: found.get(n, n) for n in want} == want
    assert connected_components(spark.createDataFrame([(None, 1)], "u long, v long")).count() == 0
