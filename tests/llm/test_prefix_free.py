import hashlib

import numpy as np
import pytest

from conftest import HARD_TEXTS, SF
from spanloom.llm import prefix_free, queries


def brute(docs, window=100):
    """By a dictionary of all windows, in the order of the corpus."""
    once = dict(sorted((d, t or "") for d, t in docs if d is not None))
    seen, out = set(), {}
    for doc_id, text in once.items():
        data = text.encode()
        cut = np.zeros(len(data) + 1, dtype=int)
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                cut[p] += 1
                cut[p + window if p + window < len(data) else -1] -= 1
            seen.add(w)
        gone = np.cumsum(cut)[: len(data)] > 0
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        out[doc_id] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted((d, *out[d]) for d, _ in docs if d is not None)


def planted(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgé"), rng.integers(2, 7))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words, k))
    line, passage = text(14), text(60)
    docs = []
    for d in range(n):
        parts = [text(rng.integers(1, 60))]
        for kind in rng.integers(0, 7, 3):
            cut = rng.integers(0, len(passage) - 150)
            parts.append([line, passage, passage[cut : cut + rng.integers(60, 150)], text(30), "ab" * 90, "", docs[rng.integers(len(docs))][1] if docs else ""][kind])
        docs.append((int(d * 3 - 50), text(2).join(parts)))
    return docs


def rows(frame):
    return sorted(tuple(r)[:5] for r in frame.collect())


@pytest.mark.parametrize("crowd", [8192, 3])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_planted(spark, crowd, batch):
    docs = planted(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, start int").repartition(5)
        assert rows(prefix_free.remove(frame, crowd=crowd)) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hard_and_empty(spark, hard_docs, no_docs):
    assert rows(prefix_free.remove(hard_docs)) == brute(HARD_TEXTS)
    assert prefix_free.remove(no_docs).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.op9_prefix_free(spark, SF)) == brute(docs)


def test_every_window_in_one_phrase(monkeypatch):
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    for piece in (1 << 20, 700):
        monkeypatch.setattr(prefix_free, "PIECE", piece)
        start, n, _ = prefix_free.phrases(data, 100, 32)
        assert (np.concatenate([np.arange(a, a + k) for a, k in zip(start, n)]) == np.arange(len(data) - 99)).all()
    assert len(prefix_free.phrases(b"x" * 99, 100, 32)[0]) == 0


def test_rolling_hash_is_of_content():
    data = np.frombuffer(b"0123456789" * 40, dtype=np.uint8)
    for length in (1, 5, 32, 100):
        h = prefix_free.rolling(data, length)
        assert len(h) == len(data) - length + 1 and (h[:-10] == h[10:]).all() and len(set(h)) == 10


def test_other_texts_of_one_id_are_documents_of_their_own(spark):
    passage = "".join(f"{k * k} " for k in range(80))
    docs = [(1, "a" + passage), (1, "bb" + passage), (1, "bb" + passage), (2, passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in prefix_free.remove(frame).collect())
    n = len(passage)
    assert got[3] == (2, n, n) and [x[:2] for x in got[:3]] == [(1, n + 1), (1, n + 2), (1, n + 2)]
    assert sorted({x[2] for x in got[:3]}) == [0, n] and got[1] == got[2]
    cut = sorted(r.text for r in prefix_free.cut(frame).collect())
    assert cut[0] == "" and sorted(map(len, cut))[1:] in ([1, n + 2, n + 2], [2, 2, n + 1])
