"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are levels of numbers about its letters and words, its
own and those of the lines before and after it; a weight for each level and for each transition
is fitted by gradient ascent with forward-backward marginals, in numpy. Labels are of documents:
in the fit a line has its document's label, and what good and bad documents share (a licence, a
boilerplate line) comes out undecided, so its neighbours decide.

A document's quality is the mean of its lines' marginals, weighted by length, through a logistic
function fitted to the labels; it also sees the log of the document's length.

The fit sees a bounded sample: of each label at most ``most`` documents, those with the smallest
hashes of their ids, and of these as many, in that order, as hold ``most_lines`` lines together.
Features are made where the texts are; one byte for each of a line's features comes to the
driver. The weights, of fixed number, are broadcast. Every document is scored whole: chains run
in stretches of lines with lead lines at both sides, and lines of any length are read in full.

Cases: a null, empty or blank text has no lines and gets the score of no evidence, the smoothed
share of label 1. Without labelled documents of both kinds every score is that share. Rows
without a doc_id are scored and have a null held_out; rows that repeat one keep a row each, and
the least of their texts is learned from. Of several labels of a document the largest counts,
null labels are left out. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches, text_of
from spanloom.llm.toxicity import forward_backward, logistic, stretches

BATCH = 2 << 20
LEVELS = 8

#: Classes of bytes whose shares of a line are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "loud": b"!?",
    "bar": b"|/\\_=<>{}[]()",
    "mark": b"*#%&$@^~+",
    "other": bytes(range(128, 256)),
}
CUTS = np.array([0.004, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
#: Features that are no shares of bytes, with the bounds of their levels.
NUMBERS = {
    "characters": np.array([8, 20, 40, 80, 160, 400, 1600]),
    "words": np.array([1, 2, 4, 8, 16, 64, 256]),
    "word_length": np.array([1.5, 3, 4, 5, 6, 8, 12]),
    "distinct": np.array([0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9]),
    "repeats": CUTS,
    "one_letter": CUTS,
    "sentence": np.array([0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.8]),
}
FEATURES = len(CLASSES) + len(NUMBERS)


@dataclass
class Lines:
    """Levels of the features of all lines of some texts, their bytes, and how many lines each text has."""

    levels: np.ndarray
    size: np.ndarray
    many: np.ndarray


def shares(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    """For each line, the share of its bytes that are of each class."""
    table, out = np.full(256, len(CLASSES), np.uint8), {}
    for k, members in enumerate(CLASSES.values()):
        table[list(members)] = k
    kind = table[raw]
    for k, name in enumerate(CLASSES):
        sums = np.append(0, np.cumsum(kind == k, dtype=np.int64))
        out[name] = (sums[stop] - sums[begin]) / (stop - begin)
    return out


def level_lines(texts: pa.Array) -> Lines:
    """Lines that are not blank, with their features' levels."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    flat = pc.ascii_trim_whitespace(lists.flatten())
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0)).astype(bool)
    offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
    many = np.diff(np.append(0, np.cumsum(real))[offsets])
    lines = flat.filter(pa.array(real))
    if not len(lines):
        return Lines(np.zeros((0, FEATURES), np.uint8), np.zeros(0, np.int64), many)
    places = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    raw = np.frombuffer(lines.buffers()[2], np.uint8)
    byte_shares = shares(raw, places[:-1], places[1:])
    size = np.diff(places)
    words = pc.ascii_split_whitespace(lines)
    of = np.asarray(words.offsets) - np.asarray(words.offsets)[0]
    code = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    line = np.repeat(np.arange(len(lines)), np.diff(of))
    n = np.diff(of)
    counted = np.unique(line * (code.max() + 1) + code)
    distinct = np.bincount(counted // (code.max() + 1), minlength=len(lines)) / n
    again = np.bincount(line[1:][(code[1:] == code[:-1]) & (line[1:] == line[:-1])], minlength=len(lines)) / n
    letters = np.asarray(pc.binary_length(words.flatten()))
    values = byte_shares | {
        "characters": size,
        "words": n,
        "word_length": (size - n + 1) / n,
        "distinct": distinct,
        "repeats": again,
        "one_letter": np.bincount(line[letters == 1], minlength=len(lines)) / n,
        "sentence": (byte_shares["stop"] + byte_shares["loud"]) * size / n,
    }
    levels = np.stack([np.searchsorted(NUMBERS.get(k, CUTS), v, side="right") for k, v in values.items()], axis=1)
    return Lines(levels.astype(np.uint8), size, many)


def with_neighbours(own: Lines) -> np.ndarray:
    """Numbers of the weights of each line: its own levels and those of the lines before and after; where there is none, one number says so."""
    at = np.arange(FEATURES) * (LEVELS + 1)
    span = FEATURES * (LEVELS + 1)
    codes = own.levels + at
    ends = np.cumsum(own.many)[own.many > 0]
    none = np.full((1, FEATURES), LEVELS) + at
    before, after = np.concatenate([none, codes[:-1]]), np.concatenate([codes[1:], none])
    before[np.append(0, ends[:-1])[: len(ends)]] = none
    after[ends - 1] = none
    return np.concatenate([codes, before + span, after + 2 * span], axis=1)


WEIGHTS = 3 * FEATURES * (LEVELS + 1)


@dataclass
class Model:
    """Weights of levels for the good state over the bad one, log potentials of the first state and of transitions, and the logistic function over documents."""

    weight: np.ndarray
    bias: float = 0.0
    first: float = 0.0
    move: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float = 0.5  # of label 1, for texts without lines


def marginals(model: Model, own: Lines, some: int = 2048) -> np.ndarray:
    """The chance that each line is good."""
    codes = with_neighbours(own) if len(own.levels) else np.zeros((0, 3 * FEATURES), int)
    unary = model.bias + model.weight[codes].sum(1)
    at, counts = stretches(own.many)
    out = np.zeros(len(unary))
    for k in range(0, len(at), some):
        part, due = at[k : k + some], counts[k : k + some]
        there = part >= 0
        values = np.clip(np.where(there, unary[part], 0.0), -30, 30)
        out[part[due]] = forward_backward(values, there, model.first, model.move)[2][due]
    return out


def evidence(p: np.ndarray, own: Lines) -> np.ndarray:
    """For each text: log odds of the mean of its lines' marginals, weighted by length; the log of its bytes; one. Texts without lines: zeros."""
    of = np.repeat(np.arange(len(own.many)), own.many)
    size = np.bincount(of, own.size, minlength=len(own.many))
    mean = np.clip(np.bincount(of, p * own.size, minlength=len(own.many)) / np.maximum(size, 1), 1e-4, 1 - 1e-4)
    return np.stack([np.log(mean / (1 - mean)), np.log1p(size) / 10, np.ones(len(size))], axis=1) * (own.many > 0)[:, None]


def fit(own: Lines, good: np.ndarray, prior: tuple[int, int], steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """A model fitted to labelled documents; ``prior``: how many of label 0 and 1 the sample stands for."""
    model = Model(np.zeros(WEIGHTS), share=(prior[1] + 0.5) / (sum(prior) + 1))
    model.logistic = (0.0, 0.0, math.log(model.share / (1 - model.share)))
    if min(prior) == 0 or len(set(good.tolist())) < 2 or not len(own.levels):
        return model
    codes, truth = with_neighbours(own), np.repeat(good.astype(float), own.many)
    at, counts = stretches(own.many)
    there = at >= 0
    begins = (np.cumsum(own.many) - own.many)[own.many > 0]
    follows = counts[:, 1:] & there[:, :-1]
    after = np.ones(len(truth), dtype=bool)
    after[begins] = False
    a, b = truth[:-1][after[1:]], truth[1:][after[1:]]
    seen = np.array([np.count_nonzero((a == x) & (b == y)) for x in (0, 1) for y in (0, 1)], dtype=float)
    shared = np.zeros(6)  # bias, first, 00, 01, 10, 11
    past, past_shared = np.full(WEIGHTS, 1e-8), np.full(6, 1e-8)
    for _ in range(steps):
        values = np.clip(np.where(there, (shared[0] + model.weight[codes].sum(1))[at], 0.0), -30, 30)
        left, right, p = forward_backward(values, there, shared[1], shared[2:])
        flat = np.zeros(len(truth))
        flat[at[counts]] = p[counts]
        e, r, x = np.exp(shared[2:]), left[:, :-1][follows], (np.exp(values) * right)[:, 1:][follows]
        joint = np.stack([np.full(len(r), e[0]), e[1] * x, e[2] * r, e[3] * r * x])
        expected = (joint / joint.sum(0)).sum(1) if len(r) else np.zeros(4)
        error = truth - flat
        slope = np.bincount(codes.ravel(), np.repeat(error, codes.shape[1]), minlength=WEIGHTS) - decay * len(truth) * model.weight
        slope_shared = np.concatenate([[error.sum(), error[begins].sum()], seen - expected]) - decay * len(truth) * np.append(0.0, shared[1:])
        past += slope**2
        past_shared += slope_shared**2
        model.weight = model.weight + rate * slope / np.sqrt(past)
        shared += rate * slope_shared / np.sqrt(past_shared)
    model.bias, model.first, model.move = float(shared[0]), float(shared[1]), tuple(shared[2:].tolist())
    x = evidence(marginals(model, own), own)
    lined = own.many > 0
    stands_for = np.where(good == 1, prior[1] / max(1, (good == 1).sum()), prior[0] / max(1, (good == 0).sum()))
    model.logistic = tuple(logistic(x[lined], good[lined], stands_for[lined], ridge=0.1).tolist())
    return model


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def featured(docs: DataFrame) -> DataFrame:
    """doc_id with the levels and bytes of its lines."""

    def run(batches):
        for batch in small_batches(batches, BATCH):
            own = level_lines(batch.column("text"))
            ends = np.cumsum(own.many)
            cells = [(own.levels[e - m : e].tobytes(), own.size[e - m : e].tobytes()) for e, m in zip(ends.tolist(), own.many.tolist())]
            columns = [batch.column("doc_id"), pa.array(own.many.tolist(), pa.int64()), pa.array([a for a, _ in cells], pa.binary()), pa.array([b for _, b in cells], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "many", "levels", "size"])

    return docs.mapInArrow(run, "doc_id long, many long, levels binary, size binary")


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, most_lines: int = 150_000) -> Model:
    """A model fitted to a bounded sample of the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known = known.where(~held_out())
    total = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.where("quality = 1").orderBy(*order).limit(most).unionByName(known.where("quality = 0").orderBy(*order).limit(most))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    one = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # at most twice ``most`` rows
    made = featured(one.select("doc_id", "text")).join(F.broadcast(picked), "doc_id").withColumn("_lines", F.sum("many").over(whole))
    rows = made.where(F.col("_lines") <= most_lines).orderBy("doc_id").collect()
    many = np.array([r.many for r in rows], dtype=np.int64)
    levels = np.frombuffer(b"".join(bytes(r.levels) for r in rows), np.uint8).reshape(-1, FEATURES)
    size = np.frombuffer(b"".join(bytes(r.size) for r in rows), np.int64)
    return fit(Lines(levels, size, many), np.array([r.quality for r in rows], dtype=np.int64), (total.get(0, 0), total.get(1, 0)))


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Lines]:
    own = level_lines(texts)
    p = marginals(model, own)
    score = 1 / (1 + np.exp(-np.clip(evidence(p, own) @ np.array(model.logistic), -700, 700)))
    return np.where(own.many > 0, score, model.share), p, own


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the number of lines of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, BATCH):
            found, _, own = scores(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(own.many.tolist(), pa.int64())], ["doc_id", "score", "n_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double, n_lines long")


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (of those that are not blank, from 0), bytes and the chance that it is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, BATCH):
            _, p, own = scores(shared.value, batch.column("text"))
            doc = np.repeat(np.arange(len(own.many)), own.many)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(own.many) - own.many, own.many)
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(line), pa.array(own.size), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "bytes", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, line long, bytes long, good double")
