"""The quality chain: features against plain loops, marginals against all paths, held-out accuracy, cases."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from conftest import SF

from spanloom.llm import quality
from spanloom.llm.queries import op13_quality, table


def plain_values(line):
    raw, words = line.encode(), line.split(" ")
    share = lambda members: sum(b in members for b in raw) / len(raw)
    out = {k: share(v) for k, v in quality.CLASSES.items()}
    n = len(words)
    return out | {
        "characters": len(raw), "words": n, "word_length": (len(raw) - n + 1) / n, "distinct": len(set(words)) / n, "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        "one_letter": sum(len(w.encode()) == 1 for w in words) / n, "sentence": sum(b in b".,;:!?" for b in raw) / n,
    }


def test_levels_equal_plain_loops():
    texts = ["  An  A A!! \n\n \nécole | * 9 x", "", "word " * 900, "a"]
    own = quality.level_lines(pa.array(texts))
    lines = [[x.strip(" ") for x in t.split("\n") if x.strip()] for t in texts]
    assert own.many.tolist() == [len(x) for x in lines]
    flat = [x for some in lines for x in some]
    assert own.size.tolist() == [len(x.encode()) for x in flat]
    for got, line in zip(own.levels.tolist(), flat):
        if "  " in line:  # words are cut at runs of blanks
            continue
        values = plain_values(line)
        assert got == [sum(v >= c for c in quality.NUMBERS.get(k, quality.CUTS)) for k, v in values.items()]


def test_neighbours_stay_inside_texts():
    own = quality.level_lines(pa.array(["one\ntwo two\nTHREE!", "", "four"]))
    codes, span = quality.with_neighbours(own), quality.FEATURES * (quality.LEVELS + 1)
    of_none = np.arange(quality.FEATURES) * (quality.LEVELS + 1) + quality.LEVELS
    width = quality.FEATURES
    assert (codes[[0, 3], width : 2 * width] == of_none + span).all() and (codes[[2, 3], 2 * width :] == of_none + 2 * span).all()
    assert (codes[1, width : 2 * width] - span == codes[0, :width]).all() and (codes[1, 2 * width :] - 2 * span == codes[2, :width]).all()


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    own = quality.level_lines(pa.array(["a b\nC!\nd d d\ne\nF9", "one | two\nx"]))
    model = quality.Model(rng.normal(size=quality.WEIGHTS) / 3, 0.2, -0.4, tuple(rng.normal(size=4)))
    unary = model.bias + model.weight[quality.with_neighbours(own)].sum(1)
    wanted, begin = [], 0
    for n in own.many.tolist():
        u = unary[begin : begin + n]
        total, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            value = math.exp(model.first * path[0] + sum(u[i] for i in range(n) if path[i]) + sum(model.move[2 * a + b] for a, b in zip(path, path[1:])))
            total += value
            good += value * np.array(path)
        wanted += (good / total).tolist()
        begin += n
    assert np.allclose(quality.marginals(model, own), wanted)


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in op13_quality(spark, sf).collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    known = [(rows[r.doc_id].predicted, r.quality) for r in table(spark, sf, "labels").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(known) > 50
    assert np.mean([p for p, q in known if q == 1]) >= 0.98 and np.mean([1 - p for p, q in known if q == 0]) >= 0.85


def test_cases(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 0), (7, 1, 1), (8, 0, 0), (9, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(hard_docs, labels)
    got = quality.score(hard_docs, model).collect()
    assert len(got) == hard_docs.count() and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.n_lines == 0}
    assert blank == {model.share}
    assert sum(r.n_lines for r in got) == quality.line_labels(hard_docs, model).count()
    for some in (labels.where("false"), labels.where("quality = 1")):
        model = quality.train(hard_docs, some)
        assert {r.score for r in quality.score(hard_docs, model).collect()} == {model.share}
    assert quality.score(no_docs, quality.train(no_docs, labels)).collect() == []


def test_long_text_is_scored_whole():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.WEIGHTS) / 5, logistic=(1.0, 0.0, 0.0))
    lines = ["good line of words here.", "BAD!! *** ###"] * 3000
    whole = quality.scores(model, pa.array(["\n".join(lines)]))[1]
    assert len(whole) == len(lines)
    again = quality.scores(model, pa.array(["\n".join(lines[2:])]))[1]
    assert np.allclose(whole[400:], again[398:], atol=1e-6)
