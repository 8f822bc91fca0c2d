"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents; the words that mark them are found first: in a toxic training
document a word is labelled toxic if one of its features (the word, its beginnings and its
end) is common in toxic documents and rare in others, and no word of a clean document is.
A two-state chain with a weight for each feature and for each transition is fitted to these
labels by gradient ascent, with forward-backward marginals, in numpy.

The fit sees a bounded sample: at most ``most_toxic`` and ``most_clean`` labelled documents
with the smallest hashes of their ids. The weights, bounded by the sample, are broadcast.
Whole texts are scored in Arrow batches: forward and backward passes run over stretches of
``STRETCH`` words of all documents at once, each with ``LEAD`` words before and after it,
over which a chain of two states forgets where it began. A document's score is a logistic
function of the expected number of toxic words and of the chance that there is one.

Cases: a null or empty text has no words and gets the score of no evidence. Without labelled
documents of both kinds the score is the smoothed share of toxic ones. Rows without a doc_id
are scored and have a null held_out. Rows that repeat a doc_id keep a row each; of their texts the least is learned from. A document
with several labels is toxic if one says so; null labels are left out. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import give_back, small_batches, text_of

WORD = re.compile(r"\w+")
STRETCH, LEAD = 128, 24
MEMO = 200_000


def features(word: str) -> list[str]:
    """The word, its first three to six letters and its last three."""
    return [word, *(f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k), f"${word[-3:]}"]


@dataclass
class Chain:
    """Weights: of features for the toxic state over the clean one, and log potentials of the first state and of transitions."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    first: float = 0.0
    move: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # from state to state: 00, 01, 10, 11
    logistic: tuple[float, float, float] = (0.0, 0.0, -4.0)  # for log(1 + expected words), log odds of any, constant

    def unary(self, word: str) -> float:
        return self.bias + sum(self.weight.get(f, 0.0) for f in features(word))


def stretches(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of word positions, stretches x (LEAD + STRETCH + LEAD), -1 where there is none, and which of them count."""
    kind = np.int32 if lengths.sum() < 1 << 30 else np.int64
    begins = np.cumsum(lengths) - lengths
    n = -(-lengths // STRETCH)
    doc = np.repeat(np.arange(len(lengths)), n)
    at = ((np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * STRETCH).astype(kind)
    places = np.arange(-LEAD, STRETCH + LEAD, dtype=kind)
    inside = at[:, None] + places
    there = (inside >= 0) & (inside < lengths[doc].astype(kind)[:, None])
    inside += begins[doc].astype(kind)[:, None]
    inside[~there] = -1
    return inside, there & (places >= 0) & (places < STRETCH)


def forward_backward(unary: np.ndarray, there: np.ndarray, first: float, move) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of the toxic state from the left (with the word itself) and from the right (without it), stretches x words, and the marginals.

    The odds r of the two states move by r' = exp(u) (e01 + e11 r) / (e00 + e10 r). Where no
    word is, the chain has not begun or is over.
    """
    e = np.exp(np.asarray(move))
    left, right = np.zeros_like(unary), np.zeros_like(unary)
    r = np.full(len(unary), np.nan)
    for t in range(unary.shape[1]):
        step = np.where(np.isnan(r), math.exp(first), (e[1] + e[3] * r) / (e[0] + e[2] * r))
        r = np.where(there[:, t], step * np.exp(unary[:, t]), np.nan)
        left[:, t] = r
    r = np.ones(len(unary))
    for t in range(unary.shape[1] - 1, -1, -1):
        right[:, t] = r
        x = r * np.exp(unary[:, t])
        r = np.where(there[:, t], (e[2] + e[3] * x) / (e[0] + e[1] * x), 1.0)
    odds = np.where(there, left * right, 0.0)
    return left, right, odds / (1 + odds)


def marginals(chain: Chain, unary: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The chance of the toxic state of each word of some documents."""
    at, counts = stretches(lengths)
    out = np.zeros(len(unary))
    for k in range(0, len(at), 2048):
        some, own = at[k : k + 2048], counts[k : k + 2048]
        there = some >= 0
        values = np.clip(np.where(there, unary[some], 0.0), -40, 40)
        out[some[own]] = forward_backward(values, there, chain.first, chain.move)[2][own]
    return out


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document, log(1 + expected toxic words) and the log odds that there is any."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    expected = np.bincount(of, p, minlength=len(lengths))
    none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(lengths))
    some = -np.expm1(none)
    odds = np.log(np.clip(some, 1e-7, None)) - np.maximum(none, math.log(1e-7))
    return np.stack([np.log1p(expected), np.clip(odds, -12, 12), np.ones(len(lengths))], axis=1)


def coded(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, and how many words each text has. Words are held by Arrow, without an object for each."""
    parts, lengths = [], []
    for k in range(0, len(texts), 64):
        words = [WORD.findall(t.lower()) for t in texts[k : k + 64]]
        lengths += map(len, words)
        parts.append(pa.array([w for doc in words for w in doc], pa.large_string()))
    one = pa.chunked_array(parts, pa.large_string()).dictionary_encode().combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    del parts
    pa.default_memory_pool().release_unused()
    return one.dictionary, one.indices.to_numpy(), np.array(lengths, dtype=np.int64)


def feature_codes(types: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in turn, by the features' hashes, and how many each word has."""
    listed, sizes = array("Q"), array("q")
    for k in range(0, len(types), 10_000):
        for w in types[k : k + 10_000].to_pylist():
            own = features(w)
            listed.extend(map(xxhash.xxh3_64_intdigest, own))
            sizes.append(len(own))
    return np.unique(np.frombuffer(listed, np.uint64), return_inverse=True)[1].astype(np.int32), np.array(sizes)


def label_words(token: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, feature: np.ndarray, sizes: np.ndarray, least: int = 5, share: float = 0.02, ratio: float = 20.0) -> np.ndarray:
    """Word labels: in toxic documents, words with a feature that ``share`` of these (``least`` at least) have, at a rate ``ratio`` times that elsewhere or more."""
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(lengths)
    found = np.zeros((2, int(feature.max()) + 1), dtype=np.int64)
    for t, begin, end in zip(toxic, ends - lengths, ends):
        own = np.unique(token[begin:end])
        n = sizes[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found[int(t), np.unique(feature[at])] += 1
    n = np.bincount(toxic.astype(int), minlength=2)
    marks = (found[1] >= max(least, share * n[1])) & (found[1] / n[1] / ((found[0] + 0.1) / n[0]) >= ratio)
    marked = np.logical_or.reduceat(marks[feature], starts)
    return marked[token] & np.repeat(toxic.astype(bool), lengths)


def fit(texts: list[str], toxic: np.ndarray, prior: tuple[int, int], steps: int = 50, rate: float = 1.0, decay: float = 1e-6) -> Chain:
    """A chain fitted to labelled documents; ``prior``: how many clean and toxic ones the sample stands for."""
    chain = Chain()
    if min(prior) == 0 or len(set(toxic.tolist())) < 2:
        share = (prior[1] + 0.5) / (sum(prior) + 1)
        chain.logistic = (0.0, 0.0, math.log(share / (1 - share)))
        return chain
    types, token, lengths = coded(texts)
    if not len(token):
        return chain
    feature, sizes = feature_codes(types)
    truth = label_words(token, lengths, toxic, feature, sizes)
    of_type, n_features = np.repeat(np.arange(len(types)), sizes), int(feature.max()) + 1
    at, counts = stretches(lengths)
    rare = math.log((truth.sum() + 1) / (len(truth) + 2)) - 2
    weight, shared = np.zeros(n_features), np.array([rare, 0.0, 0.0, 0.0, 0.0, 0.0])  # bias, first, 00, 01, 10, 11
    past_weight, past_shared = np.full(n_features, 1e-8), np.full(6, 1e-8)
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    after = np.ones(len(token), dtype=bool)
    after[begins] = False  # words with another before them
    before, now = truth[:-1][after[1:]], truth[1:][after[1:]]
    seen = np.array([float(np.count_nonzero((before == a) & (now == b))) for a in (False, True) for b in (False, True)])
    for _ in range(steps):
        unary = shared[0] + np.bincount(of_type, weight[feature], minlength=len(types))
        flat, expected, e = np.zeros(len(token)), np.zeros(4), np.exp(shared[2:])
        for b in range(0, len(at), 2048):  # stretches of bounded memory
            some, due = at[b : b + 2048], counts[b : b + 2048]
            there = some >= 0
            values = np.clip(np.where(there, unary[token[some]], 0.0), -40, 40)
            left, right, p = forward_backward(values, there, shared[1], shared[2:])
            flat[some[due]] = p[due]
            # expected transitions into each counted word with another before it
            own = due[:, 1:] & there[:, :-1]
            r, x = left[:, :-1][own], (np.exp(values) * right)[:, 1:][own]
            joint = np.stack([np.full(len(r), e[0]), e[1] * x, e[2] * r, e[3] * r * x])
            expected += (joint / joint.sum(0)).sum(1)
        error = truth - flat
        slope = np.bincount(feature, np.bincount(token, error, minlength=len(types))[of_type], minlength=n_features) - decay * len(token) * weight
        slope_shared = np.concatenate([[error.sum(), error[begins].sum()], seen - expected]) - decay * len(token) * np.concatenate([[0.0], shared[1:]])
        past_weight += slope**2
        past_shared += slope_shared**2
        weight += rate * slope / np.sqrt(past_weight)
        shared += rate * slope_shared / np.sqrt(past_shared)
    kept: dict[str, float] = {}
    strong = np.abs(weight) > 1e-3
    starts = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(np.logical_or.reduceat(strong[feature], starts)).tolist():
        own = feature[starts[k] : starts[k] + sizes[k]]
        kept.update((f, float(weight[j])) for f, j in zip(features(types[k].as_py()), own) if strong[j])
    chain = Chain(kept, float(shared[0]), float(shared[1]), tuple(shared[2:].tolist()))
    unary = np.fromiter((chain.unary(w.as_py()) for w in types), float, len(types))[token]
    x = evidence(marginals(chain, unary, lengths), lengths)
    stands_for = np.where(toxic == 1, prior[1] / (toxic == 1).sum(), prior[0] / (toxic == 0).sum())
    chain.logistic = tuple(logistic(x, toxic, stands_for).tolist())
    return chain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w += move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
    return w


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 3000) -> Chain:
    """A chain fitted to the documents that are not held out, of a bounded sample of the labels."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out())
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.where("toxic = 1").orderBy(*order).limit(most_toxic).union(known.where("toxic = 0").orderBy(*order).limit(most_clean))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    return fit(sample["text"].tolist(), sample["toxic"].to_numpy(), (total.get(0, 0), total.get(1, 0)))


class Scorer:
    """Scores texts; keeps the weights of words it has met."""

    def __init__(self, chain: Chain):
        self.chain, self.memo = chain, {}

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The words of each text, their number, and the chance of the toxic state of each."""
        split = [WORD.findall(t.lower()) for t in texts]
        new = set().union(*split) - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, set().union(*split)
        self.memo.update((w, self.chain.unary(w)) for w in new)
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        unary = np.fromiter((u for w in split for u in map(self.memo.__getitem__, w)), dtype=float, count=int(lengths.sum()))
        return split, lengths, marginals(self.chain, unary, lengths)

    def score_of(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-evidence(p, lengths) @ np.array(self.chain.logistic)))

    def scores(self, texts: list[str]) -> np.ndarray:
        _, lengths, p = self.words(texts)
        return self.score_of(p, lengths)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score and the offsets at which offending words begin, of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in small_batches(batches, 4 << 20):
            texts = batch.column("text").to_pylist()
            _, lengths, p = scorer.words(texts)
            begins = [[] for _ in texts]
            for k, begin, _, _ in offending(texts, lengths, p, 0.5):
                begins[k].append(begin)
            columns = [batch.column("doc_id"), pa.array(scorer.score_of(p, lengths)), pa.array(begins, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "offsets"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, offsets array<long>")


def clean(docs: DataFrame, chain: Chain, most: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``most``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in small_batches(batches, 4 << 20):
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(scorer.scores(texts) < most))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)


def original_places(text: str, low: str):
    """From the places of characters in ``low``, the lower case of ``text``, to those in ``text``: some characters become two."""
    if len(low) == len(text):
        return lambda at: at
    of = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
    return of.__getitem__


def offending(texts: list[str], lengths: np.ndarray, p: np.ndarray, least: float):
    """Number of the text, begin, end and chance of each word of ``least`` chance or more."""
    ends = np.cumsum(lengths)
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(p >= least), side="right")).tolist():
        own, low = p[ends[k] - lengths[k] : ends[k]], texts[k].lower()
        places, back = list(WORD.finditer(low)), original_places(texts[k], low)
        for i in np.flatnonzero(own >= least).tolist():
            yield k, back(places[i].start()), back(places[i].end() - 1) + 1, float(own[i])


def spans(docs: DataFrame, chain: Chain, least: float = 0.5) -> DataFrame:
    """Offending words: doc_id, begin and end (characters of the text as it is) and chance, in order of place."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in small_batches(batches, 4 << 20):
            texts = batch.column("text").to_pylist()
            _, lengths, p = scorer.words(texts)
            rows = [(batch.column("doc_id")[k].as_py(), *rest) for k, *rest in offending(texts, lengths, p, least)]
            doc, begin, end, chance = zip(*rows) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc, begin, end, chance), kinds)], ["doc_id", "begin", "end", "chance"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(run, "doc_id long, begin long, end long, chance double")
