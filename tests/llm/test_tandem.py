"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from conftest import SF

from spanloom.llm import tandem
from spanloom.llm.queries import op11_runs


def plain_runs(words, least=6, ratio=4):
    """(start, length, period) of all runs: for each period the stretches of words equal to the one a period ahead; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // ratio + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, ratio * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, words):
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{b},{n},{q}\n" for b, n, q in runs)), digest(left))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize(("least", "ratio"), [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(least, ratio):
    rng = random.Random(11)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 50))]
            unit = words[: rng.randint(1, 7)]
            docs.append(words + unit * rng.randint(0, 9) + ["z"] * rng.randint(0, 1) + unit * rng.randint(0, 6))
        own = tandem.split(pa.array([" ".join(d) for d in docs]))
        begin, stop, period = tandem.runs_of(own.code, own.ends, least, ratio)
        got = [[] for _ in docs]
        for b, e, q in zip(begin.tolist(), stop.tolist(), period.tolist()):
            k = next(k for k, end in enumerate(own.ends) if b < end)
            got[k].append((b - int(own.begins[k]), e - b, q))
        assert got == [plain_runs(d, least, ratio) for d in docs]


def test_blocks_are_longest_earlier_strings():
    own = tandem.split(pa.array(["a b a b a b c a b c", "", "a a a a"]))
    assert tandem.blocks(tandem.Tree(own.code, own.ends), own.ends).tolist() == [0, 1, 2, 6, 7, 10, 11]


def test_query_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op11_runs(spark, SF).collect()))
    assert got == sorted(plain_row(d, planted(d, words_of(t))) for d, t in docs)


def test_cases(spark, hard_docs, no_docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:2])
    got = sorted(map(tuple, tandem.summaries(hard_docs, change=tandem.planted).collect()), key=key)
    assert got == sorted((plain_row(r.doc_id, planted(r.doc_id, words_of(r.text))) for r in hard_docs.collect()), key=key)
    assert tandem.summaries(no_docs).collect() == []
    assert tandem.runs(no_docs).collect() == []
    assert [tuple(r) for r in tandem.runs(hard_docs).collect()] == [(8, 0, 5000, 1)]


def test_collapse_and_separators(spark):
    docs = spark.createDataFrame([(1, "x a b\x0ba\tb a b\r\na b y y y y y y z"), (2, "a\x1cb\x85c a"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in tandem.collapse(docs).collect()} == {1: "x a b y z", 2: "a\x1cb\x85c a", 3: ""}
    assert sorted(map(tuple, tandem.runs(docs).collect())) == [(1, 1, 8, 2), (1, 9, 6, 1)]
