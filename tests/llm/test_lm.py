import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanloom.llm import attention, lm

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["The cat sat on the mat.", "the cat sat", "", None, "A B\tc\n\x0bd  e ", "la casa è ñandú", "x" * 5000, "über ALLES", "the cat sat on the mat."]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, word string")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "clash") for i in range(60)] + [(None, "the cat", None), (3, "the cat", None)]
    return rows, lm.score(frame(spark, rows), VOCABULARY, head=4).collect()


def test_base_score_against_brute_force(scored):
    rows, got = scored

    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    train = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in words(t))
    counts[None] = len(train)
    total, types = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        own = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        out = None if i is None else zlib.crc32(str(i).encode()) % 5 == 1
        want.append((str(i), str(out), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    assert sorted(want) == sorted((str(r.doc_id), str(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)


def test_an_empty_table(spark):
    assert lm.score(frame(spark, []), VOCABULARY).count() == 0


def model_of(texts, rounds=3, most_rows=4096):
    cut = attention.subwords(VOCABULARY)
    parts = [np.append(cut.encode(t.lower().encode().split())[0], 0) for t in texts]
    ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
    counts = np.bincount(ids, minlength=cut.size).astype(float)
    _, row = attention.rows_of(counts, most_rows)
    size = int(row.max()) + 1
    own = row[ids]
    pairs = np.zeros((size, size), np.float32)
    np.add.at(pairs, (np.append(0, own[:-1]), own), 1)
    contexts = min(lm.CONTEXTS, size)
    group = attention.classes(counts, most_rows, pairs[:contexts].T.astype(float), pairs[:, :contexts].astype(float))
    model = attention.start(counts, most_rows, group, pairs)
    all_windows = np.append(ids, -1)[attention.windows(lengths, *attention.window_starts(lengths))]
    for _ in range(rounds):
        attention.learn(model, iter([all_windows]), 0.1, batch=16)
    return cut, ids, lengths, model


PROSE = ["the cat sat on the mat and the dog sat on the cat", "la casa es grande y la mesa es roja", "the dog and the cat " * 9] * 40


def test_windows_score_each_id_once_with_the_ids_before_it():
    lengths = np.array([1, 15, 16, 17, 200, 64, 65, 1, 32, 33])
    of, begin = attention.window_starts(lengths)
    at = attention.windows(lengths, of, begin)
    scored = at[:, attention.LEAD + 1 :]
    assert sorted(scored[scored >= 0].tolist()) == list(range(lengths.sum()))
    begins = np.cumsum(lengths) - lengths
    for k, row in zip(of, at):
        for t in np.flatnonzero(row[attention.LEAD + 1 :] >= 0) + attention.LEAD + 1:
            before = row[:t][row[:t] >= 0]
            assert before.tolist() == list(range(row[t] - len(before), row[t])) and len(before) >= min(attention.LEAD, row[t] - begins[k])


def plain_chance(model, ids, begin, t):
    """The chance of ids[t], an id of the text that begins at begin, by loops and double precision."""
    w, rows = {k: v.astype(float) for k, v in model.weights.items()}, model.row
    first = (t - begin) // attention.STEP * attention.STEP + begin - attention.LEAD - 1  # the first input of its window
    inputs = [rows[ids[k]] if k >= begin else rows[0] for k in range(first, t)]
    x = [w["x"][r] for r in inputs]
    query, total, attended = x[-1][: attention.KEY], 0.0, np.zeros(attention.VALUE)
    for back, row in enumerate(reversed(x)):
        weight = math.exp(float(query @ row[attention.KEY : 2 * attention.KEY]) - attention.FALL * back)
        total += weight
        attended += weight * row[attention.VALUE_AT : attention.VALUE_AT + attention.VALUE]
    h = np.tanh(attended / total @ w["o"] + x[-1][attention.OWN_AT :] + w["p"][inputs[-2]])
    logits = h @ w["c"] + w["cb"] + model.follows[inputs[-1]]
    group = model.group[ids[t]]
    value = logits[group] - math.log(np.exp(logits).sum())
    own = rows[ids[t]]
    return value + (model.rest[ids[t]] - model.whole[inputs[-1], group] if own == len(model.inside) - 1 else model.inside[inputs[-1], own])


@pytest.mark.parametrize("most_rows", [4096, 12])
def test_chances_against_plain_loops(most_rows):
    _, ids, lengths, model = model_of(PROSE, most_rows=most_rows)
    got = model.log_chance(ids, lengths, most=5)
    begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
    want = [plain_chance(model, ids, b, t) for t, b in enumerate(begins)]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-5)
    assert abs(got.sum() - sum(want)) < 1e-6 * abs(sum(want))


@pytest.mark.parametrize("most_rows", [4096, 12])
def test_chances_add_up_to_one_and_only_look_back(most_rows):
    cut, ids, lengths, model = model_of(PROSE, most_rows=most_rows)
    context = ids[:5]
    total = 0.0
    for b in range(0, cut.size, 4096):
        some = np.arange(b, min(cut.size, b + 4096))
        rows = np.concatenate([np.append(context, k) for k in some]).astype(np.int32)
        total += np.exp(model.log_chance(rows, np.full(len(some), 6))[5::6]).sum()
    assert total == pytest.approx(1, abs=1e-4)
    one, two = (model.log_chance(np.append(context, k).astype(np.int32), np.array([6])) for k in (7, 700))
    assert np.allclose(one[:5], two[:5])


def test_slopes_lower_the_loss():
    _, ids, lengths, model = model_of(PROSE)
    plain = model_of(PROSE, rounds=0)[3]
    assert model.log_chance(ids, lengths).sum() > plain.log_chance(ids, lengths).sum() + 0.05 * len(ids)


def test_slopes_against_differences():
    _, ids, lengths, model = model_of(PROSE, rounds=1)
    some = np.append(ids, -1)[attention.windows(lengths, *attention.window_starts(lengths))][:12]
    known = [r[r >= 0] for r in some]

    def loss(m):
        at = np.maximum(some, 0)
        inputs, target = m.row[at[:, :-1]], some[:, attention.LEAD + 1 :]
        inputs = np.where(some[:, :-1] < 0, m.row[0], inputs)
        own = target >= 0
        h = m.hidden(inputs)[own].astype(float)
        logits = h @ m.weights["c"] + m.weights["cb"] + m.follows[inputs[:, attention.LEAD :][own]]
        return -(logits[np.arange(len(h)), m.group[target[own]]] - np.log(np.exp(logits).sum(1))).mean()

    assert known
    for name, at in (("o", (3, 5)), ("c", (4, 1)), ("p", (int(model.row[ids[0]]), 2)), ("x", (int(model.row[ids[0]]), attention.VALUE_AT + 1)), ("x", (int(model.row[ids[0]]), 1)), ("x", (int(model.row[ids[1]]), attention.KEY + 1))):
        ends = []
        for sign in (1, -1):
            moved = attention.copy_of(model)
            moved.weights[name][at] += sign * 2e-2
            ends.append(loss(moved))
        slope = (ends[0] - ends[1]) / 4e-2
        after = attention.copy_of(model)
        for past in after.past.values():
            past[...] = 1e12  # so that a step is the slope, scaled
        attention.step(after, some, 1e6 * 1e-2)
        assert (model.weights[name][at] - after.weights[name][at]) / 1e-2 == pytest.approx(slope, rel=0.05, abs=2e-4), name


def test_what_workers_change_is_averaged(spark):
    model = model_of(PROSE, rounds=0)[3]
    one, two, after = (attention.copy_of(model) for _ in range(3))
    one.weights["x"][2] += 1
    two.weights["x"][2] += 3
    two.weights["o"][1] -= 4
    rows = {}
    for worker in (one, two):
        for name, first, change in attention.changes(model, worker):
            rows[name, first] = rows.get((name, first), 0) + change
    for (name, first), total in rows.items():
        attention.add_changes(after, name, first, total)
    assert np.allclose(after.weights["x"][2], model.weights["x"][2] + 2) and np.allclose(after.weights["o"][1], model.weights["o"][1] - 4)
    assert np.array_equal(after.weights["x"][3:], model.weights["x"][3:])


def test_every_training_text_is_learned_from(spark):
    """Each text gives a window at least, long texts one in ``every``; pairs are of all ids."""
    rows = [(i, f"word{i} " * n, "") for i, n in enumerate([0, 1, 5, 300, 4000])]
    cut = attention.subwords(VOCABULARY)
    texts = frame(spark, rows).select("doc_id", "text")
    row = np.minimum(np.arange(cut.size), 50).astype(np.int32)
    got = lm.gather(texts, row, VOCABULARY, 4, 3).collect()
    seen = np.concatenate([lm.windows_in(r.windows, cut.size) for r in got if r.code is None])
    lengths = [len(cut.encode(t.encode().split())[0]) + 1 for _, t, _ in rows]
    want = sum(max(1, (-(-n // attention.STEP)) // 4) for n in lengths)
    assert want <= len(seen) <= want + len(rows) and sum(r.n for r in got if r.code is not None) == sum(lengths)
    assert sum(r.n for r in got if r.code is None) == len(seen)
    assert {r.round for r in got if r.code is None} == {0, 1, 2}


def test_scores_of_documents_against_plain_loops(spark, monkeypatch):
    cut, _, _, model = model_of(PROSE)
    monkeypatch.setattr(lm, "train", lambda *a, **b: model)
    rows = [(i, t, None) for i, t in enumerate(TEXTS)]
    for r in lm.score(frame(spark, rows), VOCABULARY).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), TEXTS[r.doc_id] or ""))
        ids = np.append(cut.encode([w.encode() for w in words])[0], 0)
        want = sum(plain_chance(model, ids, 0, t) for t in range(len(ids))) / math.log(10)
        assert r.score == pytest.approx(want, rel=1e-5)


def test_words_are_cut_into_their_bytes():
    cut = attention.subwords(VOCABULARY)
    words = ["über".encode(), b"\xff\x00", " 日本".encode(), b"the"]
    ids, lengths = cut.encode(words)
    pieces = [cut.pieces[i] for i in ids]
    ends = np.cumsum(lengths)
    assert [b"".join(pieces[e - n : e]) for e, n in zip(ends, lengths)] == [b" " + w for w in words]


def test_every_window_is_learned_from_by_default():
    import inspect

    from spanloom.llm import lm

    assert inspect.signature(lm.train).parameters["every"].default == 1


def test_softmax_and_a_window_without_scored_ids():
    """Chances need no pass for a maximum, and a window that scores nothing changes no step."""
    rng = np.random.default_rng(2)
    logits = rng.normal(-3, 2, (50, 7)).astype(np.float32)
    plain = np.exp(logits.astype(float))
    assert np.allclose(attention.softmax(logits.copy()), plain / plain.sum(1, keepdims=True), rtol=1e-5)
    _, ids, _, model = model_of(PROSE, rounds=0)
    alone, padded = attention.copy_of(model), attention.copy_of(model)
    some = np.append(ids, -1)[attention.windows(np.array([40]), np.array([0]), np.array([0]))]
    attention.step(alone, some, 0.1)
    attention.step(padded, np.concatenate([some, np.where(np.arange(some.shape[1]) <= attention.LEAD, some, -1)]), 0.1)
    for name in ("c", "cb", "o", "p"):
        assert np.allclose(alone.weights[name], padded.weights[name], atol=2e-5), name


class Captured:
    """Stands for a table: keeps the function given to mapInArrow, so that it runs in this process."""

    sparkSession = sparkContext = property(lambda self: self)
    broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_scoring_holds_a_part_of_a_large_batch_at_a_time():
    """12 MB of ids in one Arrow batch: the pass that scores took 25 MB for it when this was written, 176 MB for a batch of 13 MB of texts when it cut them again."""
    import tracemalloc

    import pyarrow as pa

    cut, ids, _, model = model_of(PROSE)
    texts = [np.resize(ids, n).astype(lm.kind_of(cut.size)) for n in [2000] * 3000]
    lengths = np.array([len(t) for t in texts])
    numbers = pa.array(range(len(texts)))
    stored = lm.stored_ids(np.concatenate(texts), lengths)
    batch = pa.RecordBatch.from_arrays([*[numbers] * 4, numbers.cast(pa.float64()), stored], ["place", "doc_id", "n_tokens", "known", "base", "ids"])
    run = lm.score_rows(Captured(), model, VOCABULARY)
    tracemalloc.start()
    got = pa.Table.from_batches(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    want = model.log_chance(texts[0], lengths[:1]).sum() / math.log(10)
    assert got.num_rows == len(texts) and np.allclose(got["score"], want, rtol=1e-5)


def test_stored_ids_come_back_from_slices():
    lengths = np.array([3, 1, 5, 2])
    ids = np.arange(11, dtype="<u2")
    stored = lm.stored_ids(ids, lengths)
    got, n = lm.ids_in(stored.slice(1, 2), 50_000)
    assert got.tolist() == list(range(3, 9)) and n.tolist() == [1, 5]
    assert lm.ids_in(stored.slice(2, 0), 50_000)[0].tolist() == []


def test_sums_by_row_against_plain_loops():
    rng = np.random.default_rng(4)
    rows = np.append(rng.zipf(1.4, 900) % 300, [70_000] * 20)
    d = rng.normal(size=(len(rows), 6)).astype(np.float32)
    there, got = attention.summed_by_row(rows, d)
    assert sorted(there.tolist()) == sorted(set(rows.tolist()))
    assert all(np.allclose(s, d[rows == r].sum(0), atol=1e-4) for r, s in zip(there, got))


def test_tanh_by_an_exponential():
    x = np.array([-300, -20, -1, -1e-4, 0, 1e-4, 0.3, 5, 300], np.float32)
    assert np.allclose(attention.tanh(x.copy()), np.tanh(x.astype(float)), atol=2e-7)


def test_arrays_of_a_megabyte_take_held_memory():
    """Where the C library gives each back at once, as in a fresh worker, their pages are made anew each time."""
    import os
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from spanloom.llm.common import hold_freed
def faults():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(100):
        np.ones(1 << 18, np.float32)
    return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before
first = faults()
hold_freed()
faults()
print(first, faults())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code], env=os.environ | {"MALLOC_MMAP_THRESHOLD_": "131072", "PYTHONPATH": root}, capture_output=True, text=True, check=True)
    first, held = map(int, said.stdout.split())
    assert first > 10_000 and held < first / 10
