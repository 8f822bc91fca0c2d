import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from conftest import HARD_TEXTS
from spanloom.llm import near_copies
from test_simhash import plain_components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """The doc_ids that stay, and the pairs at 0.8 or more."""
    sets = [(d, plain_set(t)) for d, t in docs if d is not None]
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x == y or 5 * len(x & y) >= 4 * len(x | y)]
    return sorted(set(plain_components({d for d, _ in sets}, pairs).values())), pairs


def edited_texts():
    """Copies of some texts with a share of words changed, so that similarities lie on both sides of 0.8; some groups share most of their words."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 60, 200]))] + (common if g % 3 == 0 else [])
        for _ in range(8):
            words = list(base)
            for k in rng.sample(range(len(words)), int(len(words) * rng.choice([0, 0.01, 0.02, 0.025, 0.04, 0.1]))):
                words[k] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs) + k, f"own{k} " + " ".join(common)) for k in range(20)]
    return docs


@pytest.mark.parametrize("block,pivots", [(1024, 8), (3, 8), (3, 1)])
def test_against_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    docs = edited_texts()
    want, pairs = brute(docs)
    sets = {d: plain_set(t) for d, t in docs}
    assert sum(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9 for a, b in pairs) > 10
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in near_copies.representatives(rows, block).collect()) == want


def test_stage_takes_pairs_that_simhash_does_not(spark):
    docs = edited_texts()
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect()) == brute(docs)[0]


def test_hard_and_empty(spark, hard_docs, no_docs):
    assert sorted(r.doc_id for r in near_copies.representatives(hard_docs).where("doc_id is not null").collect()) == brute(HARD_TEXTS)[0]
    assert near_copies.representatives(no_docs).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "one two three four five six", 1), (1, "seven eight nine ten eleven twelve", 2), (1, "seven eight nine ten eleven twelve", 3), (2, "ONE two three four five six", 4)]
    kept = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string, tag int")).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in kept) == [(1, "one t"), (1, "seven")]


def test_bounds_never_refuse_an_alike_pair(spark):
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        apart = np.bitwise_count((near_copies.sketch(a) ^ near_copies.sketch(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_alike_share_a_first_token():
    rng = np.random.default_rng(2)
    common = np.sort(rng.choice(400, 60, replace=False)).astype(np.uint64)
    rank = rng.permutation(60)
    for n in list(range(1, 40)) + [150]:
        a = np.sort(rng.choice(400, n, replace=False)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(n) < 0.9], rng.choice(400, n // 10).astype(np.uint64)]))
        if len(b) and near_copies.alike(a, b):
            assert set(near_copies.first_tokens(a, common, rank)) & set(near_copies.first_tokens(b, common, rank))
