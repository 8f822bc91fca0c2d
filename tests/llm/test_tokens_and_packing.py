import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import HARD_TEXTS, SF
from spanloom.llm import packing, queries, subwords, token_orc
from spanloom.llm.common import shared_folder
from spanloom.llm.subwords import ByteBPE

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_memo_equals_library(library, spark):
    texts = [t or "" for _, t in HARD_TEXTS] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    texts += (edge := ["a\n b", "a \n b", " a\tb ", "a  b", "a\n\n  b\n", "\n", " ", "it's 'll\n x"])
    want += [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in edge]
    assert ByteBPE(PATH).encode(texts) == want
    assert ByteBPE(PATH).encode(["a <|endoftext|> b", "<|endoftext", "x<|endoftext|>"]) == [np.array(x, dtype="<u4").tobytes() for x in ([64, 220, 50256, 275], library.encode("<|endoftext").ids, [87, 50256])]
    few = ByteBPE(PATH, entries=50)
    assert [few.encode([t])[0] for t in texts] == want


def check_tokens(rows, docs, library):
    start, got = 0, sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)
    want = []
    for doc_id, text in sorted((a, b or "") for a, b in docs if a is not None):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_orc_round_trip(spark, hard_docs, no_docs, library):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_tokens(queries.op2_token_orc(spark, SF).collect(), documents, library)
    for docs, want in ((hard_docs, HARD_TEXTS), (no_docs, [])):
        path = shared_folder(spark, "t")
        token_orc.write_tokens(docs, path, PATH, 2)
        tokens = token_orc.read_tokens(spark, path)
        check_tokens(token_orc.positions(token_orc.digests(tokens), tokens).collect(), want, library)
    assert token_orc.lookup(spark, path, [5]).count() == 0


def test_starts_of_repeated_ids(spark, library):
    texts = ["one two three", "x", "many more words than that", "", "one two three"]
    docs = spark.createDataFrame([(i // 5, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    path = shared_folder(spark, "t")
    token_orc.write_tokens(docs, path, PATH, 2)
    tokens = token_orc.read_tokens(spark, path)
    rows = token_orc.positions(token_orc.digests(tokens), tokens).collect()
    corpus = [x for r in sorted(tokens.collect(), key=lambda r: (r.part, r.before)) for x in r.ids]
    assert len(rows) == 15 and all(crc(corpus[r.start : r.start + r.n_tokens]) == r.ids_crc32 for r in rows)
    assert sorted(r.start for r in rows) == [0, *np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1]]
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(r.doc_id for r in rows)


def test_lookup_and_pushdown(spark, hard_docs, library):
    path = shared_folder(spark, "t")
    token_orc.write_tokens(hard_docs, path, PATH, 2)
    found = token_orc.lookup(spark, path, [1, 3])
    assert {r.doc_id: list(r.ids) for r in found.collect()} == {1: library.encode(HARD_TEXTS[0][1], add_special_tokens=False).ids + [2], 3: [2]}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def check_pieces(rows, docs, library, window=2048):
    ids = defaultdict(list)
    for doc_id, text in docs:
        if doc_id is not None:
            ids[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for doc_id, pieces in by_doc.items():
        copies = ids[doc_id]
        assert len({tuple(x) for x in copies}) == 1
        covered = np.zeros(len(copies[0]), dtype=int)
        for p in pieces:
            own = copies[0][p.start : p.start + p.length]
            assert 0 < p.length == len(own) and crc(own) == p.ids_crc32 and p.doc_tokens == len(copies[0])
            covered[p.start : p.start + p.length] += 1
        assert (covered == len(copies)).all()
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(by_sequence)


def test_packing(spark, hard_docs, no_docs, library):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    padding, n = check_pieces(queries.op6_packing(spark, SF).collect(), documents, library)
    assert padding < 0.02 * 2048 * n + 4 * 2048
    rows = packing.pack(hard_docs, PATH, 1).collect()
    check_pieces(rows, HARD_TEXTS, library)
    assert all(crc(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(no_docs, PATH, 1).count() == 0


def brute(at, penalty, window, least_power):
    cost = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                pad = 0 if n == window or (n & (n - 1) == 0 and n >= least_power) else window - n
                cost[j] = min(cost[j], cost[i] + pad + penalty[j])
    return cost[-1]


def test_dynamic_program_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = [0, *np.cumsum(rng.integers(1, 20, 40)).tolist()]
        penalty = [0, *rng.choice([0, 4, 32], 40).tolist()]
        cuts = packing.best_cuts(at, penalty, 64, 8, final=True)
        total, begin = 0, 0
        for c in cuts:
            n = c - begin
            assert n <= 64
            total += (0 if n == 64 or (n & (n - 1) == 0 and n >= 8) else 64 - n) + penalty[at.index(c)]
            begin = c
        assert cuts[-1] == at[-1] and total == brute(at, penalty, 64, 8)


def test_stretches_join():
    packer = packing.Packer(64, np.array([False, True]), stretch=200, gap=32, step=8, least_power=8)
    rng, found, docs = np.random.default_rng(2), [], {}
    for d in range(50):
        docs[d] = (rng.random(rng.integers(1, 150)) < 0.1).astype("<u4")
        found += packer.add(d, docs[d].tobytes())
    found += packer.close(final=True)
    joined = defaultdict(bytes)
    for doc_id, start, length, total, _, _, ids in sorted(found, key=lambda x: x[:2]):
        assert start * 4 == len(joined[doc_id]) and length * 4 == len(ids) and total == len(docs[doc_id])
        joined[doc_id] += ids
    assert joined == {d: x.tobytes() for d, x in docs.items()}


def test_splits_over_bytes_equal_the_pattern():
    rng = np.random.default_rng(5)
    letters = list("aabs'stdrevellm  \t\n\r  ,.!0129éß×÷µªº¡»Āɏ–’…€\x01-")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + ["", "'", "'s", "'l", "'r", " '", "a'", "ve"]
    data, starts = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
    at = subwords.splits(np.frombuffer(data, np.uint8), starts)
    assert [data[a:b].decode() for a, b in zip(at[:-1], at[1:])] == [w for t in texts for w in subwords.PRETOKEN.findall(t)]


def test_what_is_known_is_looked_up_not_gone_through():
    """A view of all known keys was gone through for each few texts."""

    class Known(dict):
        def keys(self):
            raise AssertionError("all known keys are gone through")

    memo = subwords.Memo(10)
    memo.now, memo.older = {"a": 1}, Known(b=2)
    assert memo.missing({"a", "b", "c"}) == ["c"] and memo.now == {"a": 1, "b": 2}
