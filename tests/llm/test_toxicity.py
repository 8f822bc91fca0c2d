import itertools
import math
import zlib

import numpy as np
import pytest

from conftest import HARD_TEXTS
from spanloom.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    move = rng.normal(size=4)
    unary, first, n = rng.normal(size=(1, 6)), 0.3, 6
    total, marked = 0.0, np.zeros(n)
    for states in itertools.product((0, 1), repeat=n):
        s = first * states[0] + sum(u for u, y in zip(unary[0], states) if y) + sum(move[2 * a + b] for a, b in zip(states, states[1:]))
        total += math.exp(s)
        marked += np.array(states) * math.exp(s)
    _, _, p = toxicity.forward_backward(unary, np.ones((1, n), dtype=bool), first, move)
    assert np.allclose(p[0], marked / total)


def test_stretches_do_not_change_marginals():
    rng = np.random.default_rng(2)
    chain = toxicity.Chain(first=-1.0, move=(0.4, -0.4, -0.3, 0.8))
    lengths = np.array([0, 1, 500, 127, 128, 129, 0])
    unary = rng.normal(size=lengths.sum())
    got = toxicity.marginals(chain, unary, lengths)
    begin = 0
    for n in lengths:
        if n:
            own = unary[None, begin : begin + n]
            want = toxicity.forward_backward(own, np.ones(own.shape, dtype=bool), chain.first, chain.move)[2][0]
            assert np.allclose(got[begin : begin + n], want, atol=1e-6)
        begin += n


def planted(n=400):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for d in range(n):
        text, bad = rng.choice(words, rng.integers(5, 80)).tolist(), d % 5 == 0
        for _ in range(3 * bad):
            text.insert(rng.integers(len(text)), rng.choice(["vileword", "badstem" + rng.choice(words), "nasty"]))
        docs.append((d, " ".join(text)))
        labels.append((d, int(bad)))
    return docs, labels


def test_held_out_and_spans(spark):
    docs, labels = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")  # noqa: E741
    chain = toxicity.train(d, l)
    scores = {r.doc_id: r.score for r in toxicity.score(d, chain).collect()}
    held = [(scores[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    texts = dict(docs)
    found = {(r.doc_id, texts[r.doc_id][r.begin : r.end]) for r in toxicity.spans(d, chain).collect()}
    assert {w[:3] for _, w in found} <= {"vil", "bad", "nas"} and len({i for i, _ in found}) > 70
    left = toxicity.clean(d, chain)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, s in scores.items() if s < 0.3}


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)]])
def test_hard_and_one_sided(spark, hard_docs, no_docs, labels):
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(hard_docs, toxicity.train(hard_docs, frame)).collect()
    assert len(rows) == len(HARD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.train(no_docs, frame)).count() == 0


def test_query(spark):
    rows = queries.op4_toxicity(spark, SF).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_offsets_are_of_the_text_as_it_is(spark):
    chain = toxicity.Chain({"vile": 9.0}, -4.0, 0.0, (0.0, -1.0, 0.0, 0.0), (1.0, 0.0, -1.0))
    text = "İİ good Vile, İ vile"  # the first letter becomes two in lower case
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, score int")
    assert [text[r.begin : r.end] for r in toxicity.spans(docs, chain).orderBy("begin").collect()] == ["Vile", "vile"]
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert [text[b : b + 4] for b in got[1].offsets] == ["Vile", "vile"] and got[2].offsets == [] == got[3].offsets


def test_document_scores_against_plain_sums(spark):
    chain = toxicity.Chain({"vile": 3.0, "^goo": -1.0}, -1.0, 0.2, (0.1, -0.5, -0.3, 0.6), (0.7, 0.2, -1.5))
    for text in ("", "vile", "good vile gold", "a vile b vile"):
        words = text.split()
        total, toxic, clean = 0.0, [0.0] * len(words), 0.0
        for states in itertools.product((0, 1), repeat=len(words)):
            value = sum(chain.unary(w) for w, s in zip(words, states) if s) + (chain.first * states[0] if states else 0)
            weight = math.exp(value + sum(chain.move[2 * a + b] for a, b in zip(states, states[1:])))
            total += weight
            toxic = [t + weight * s for t, s in zip(toxic, states)]
        p = [t / total for t in toxic]
        none = math.prod(1 - x for x in p)
        odds = max(-12, min(12, math.log(max(1 - none, 1e-7)) - max(math.log(none), math.log(1e-7))))
        want = 1 / (1 + math.exp(-(0.7 * math.log1p(sum(p)) + 0.2 * odds - 1.5)))
        got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), chain).first().score
        assert got == pytest.approx(want, abs=1e-9), text
