"""Periodic runs of words, by the linear method for tandem repeats of Gusfield and Stoye.

Texts are cut into words; the documents of an Arrow batch are laid one behind the other, with
a number for each word that no other document shares, so that no match crosses two. Per batch:

1. ``Tree``: names of all substrings of 2, 4, 8, ... words, which are the nodes of the suffix
   tree at those depths: a node's leaves stand side by side in the suffix array.
2. LZ blocks: each begins where the one before ends and is the longest string that also starts
   earlier, or one new word (``blocks``).
3. Leftmost-covering repeats: around each block border, matches to both sides for all periods
   up to the length of the block, or of the block and the next one (``borders``). The leftmost
   place of any power ``u^k``, k >= 2, lies across or beside a border, so each kind is met.
4. The vocabulary: from a found repeat, the suffix link leads to the string without its first
   word; with that word added behind, it is the next rotation, as far as the repeat goes. A
   node met twice ends the walk there (``vocabulary``).
5. The leaves below the nodes of the vocabulary are all places of these repeats (``places``);
   neighbouring places of one period merge into maximal runs (``runs_of``).

A run is a stretch with smallest period q and length >= max(least, ratio * q) that no
neighbouring word extends keeping the period. A batch holds about 2 MB of texts (a longer one
stands alone), so memory is bounded by the longest text, and Spark deals the texts out.

Cases: a null, empty or blank text has no words and no runs. Rows without a doc_id, or that
repeat one, keep a row each. An empty table gives an empty table. Columns other than doc_id
and text are not read. Of runs with equal exponents the first start, then the smallest period,
is the greatest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches, text_of

BATCH = 2 << 20


@dataclass
class Words:
    """The words of some texts, one behind the other: Arrow strings, their numbers, and where each text ends."""

    words: pa.Array
    code: np.ndarray
    ends: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def split(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0)).astype(bool)
    offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
    ends = np.concatenate([[0], np.cumsum(real)])[offsets[1:]].astype(np.int64)
    words = flat.filter(pa.array(real))
    return Words(words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), ends)


def rewritten(own: Words, take: np.ndarray) -> Words:
    """The same texts with other words at their places: ``take`` has the number of each place's new word."""
    return Words(own.words.take(pa.array(take)), own.code[take], own.ends)


class Tree:
    """Names of the substrings of 1, 2, 4, ... words at each place, up to the length where all differ.

    A name is the place of the node's first leaf in the suffix array ``sa``. Substrings that
    reach beyond their text have names of their own.
    """

    def __init__(self, code: np.ndarray, ends: np.ndarray):
        n = len(code)
        lengths = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), lengths)
        self.end = np.repeat(ends, lengths)
        key = doc * (int(code.max()) + 1 if n else 1) + code
        rank, active = self._split(np.zeros(n, dtype=np.int64), np.arange(n), key)
        self.names, h = [self._padded(rank)], 1
        while len(active):
            ahead = active + h
            after = np.where(ahead < self.end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
            rank, active = self._split(rank.copy(), active, rank[active] * (n + 1) + after)
            self.names.append(self._padded(rank))
            h *= 2
        self.sa = np.empty(n, dtype=np.int64)
        self.sa[rank] = np.arange(n)
        self.rank = rank

    @staticmethod
    def _padded(rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int32)

    @staticmethod
    def _split(rank: np.ndarray, places: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of ``places``, whose keys order them inside their old rank, and those whose rank is still shared."""
        if not len(places):
            return rank, places
        order = np.argsort(key, kind="stable")
        at, sorted_key = places[order], key[order]
        first = np.append(True, sorted_key[1:] != sorted_key[:-1])
        old = rank[at]
        begin = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat((old + inside)[starts], sizes)
        return rank, at[np.repeat(sizes > 1, sizes)]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i and from places j on are equal; i < j."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += same
            j += same
        return i - begin

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before places i and before places j are equal; i < j."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            step = 1 << k
            there = i >= step
            same = (there & (self.names[k][np.where(there, i - step, 0)] == self.names[k][np.where(there, j - step, 0)])).astype(np.int64) << k
            i -= same
            j -= same
        return begin - i


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Where the nearest smaller value before each one stands, -1 if nowhere."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero((at >= 0) & (values[at] > values))
    while len(open_):
        at[open_] = at[at[open_]]
        now = at[open_]
        open_ = open_[(now >= 0) & (values[now] > values[open_])]
    return at


def blocks(tree: Tree, ends: np.ndarray) -> np.ndarray:
    """Where the LZ blocks of all texts begin."""
    n = len(tree.sa)
    left = smaller_before(tree.sa)
    falling = tree.sa - np.repeat(np.arange(len(ends)) * n, np.diff(ends, prepend=0))  # no look into the next text
    right = n - 1 - smaller_before(falling[::-1])[::-1]
    longest = np.zeros(n, dtype=np.int64)
    for near in (left, right):
        there = np.flatnonzero((near >= 0) & (near < n))
        i, j = tree.sa[near[there]], tree.sa[there]
        same = tree.names[0][i] == tree.names[0][j]
        i, j = i[same], j[same]
        longest[j] = np.maximum(longest[j], tree.ahead(i, j))
    step = (np.arange(n) + np.maximum(longest, 1)).tolist()
    found, at = [], 0
    while at < n:  # a block never crosses the end of its text
        found.append(at)
        at = step[at]
    return np.array(found, dtype=np.int64)


def _each(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each begin ``many`` times, with 1, 2, ... beside it."""
    from_ = np.cumsum(many) - many
    return np.repeat(begin, many), np.arange(int(many.sum())) - np.repeat(from_, many) + 1


def borders(code: np.ndarray, tree: Tree, starts: np.ndarray, least: int, ratio: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of repeats around block borders; of equal stretches the smallest period."""
    n = len(code)
    stops = np.append(starts[1:], n)
    size = stops - starts
    both = size + np.where(stops < tree.end[starts], np.append(size[1:], 0), 0)
    found = []
    # periods up to a block's length, at its end; up to its and the next one's, at its start
    border, period = _each(stops, np.where(stops < tree.end[starts], size, 0))
    found.append((border - period, border))
    border, period = _each(starts, np.minimum(both, tree.end[starts] - starts - 1))
    found.append((border, border + period))
    parts = []
    for i, j in found:
        same = code[i] == code[j]
        i, j = i[same], j[same]
        begin, stop = i - tree.back(i, j), j + tree.ahead(i, j)
        long = stop - begin >= np.maximum(least, ratio * (j - i))
        parts.append(np.stack([begin, stop, j - i])[:, long])
    return unique_runs(*np.concatenate(parts, axis=1))


def unique_runs(begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((period, stop, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    new = np.append(True, (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1]))[: len(begin)]
    return begin[new], stop[new], period[new]


def vocabulary(tree: Tree, begin: np.ndarray, stop: np.ndarray, period: np.ndarray, least: int, ratio: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place, length and period of each kind of repeat: rotations by suffix links, each node once."""
    length = np.maximum(least, ratio * period)
    walk = np.minimum(period, stop - begin - length + 1)
    at, step = _each(begin, walk)
    at = at + step - 1
    length, period = np.repeat(length, walk), np.repeat(period, walk)
    level = np.frexp(length.astype(float))[1] - 1  # 2 ** level <= length
    nodes = np.zeros((2, len(at)), dtype=np.int64)
    for k in np.unique(level).tolist():
        own = level == k
        nodes[:, own] = tree.names[k][at[own]], tree.names[k][at[own] + length[own] - (1 << k)]
    _, one = np.unique(np.stack([length, period, *nodes]), axis=1, return_index=True)
    return at[one], length[one], period[one]


def places(tree: Tree, at: np.ndarray, length: np.ndarray, period: np.ndarray):
    """Begin, end and period of all places of the kinds: the leaves below their nodes."""
    level = np.frexp(length.astype(float))[1] - 1
    for k in np.unique(level).tolist():
        own = level == k
        names, size = tree.names[k], 1 << k
        node = names[tree.sa]
        first = names[at[own]]
        leaves = np.searchsorted(node, first, side="right") - np.searchsorted(node, first, side="left")
        leaf, step = _each(first.astype(np.int64), leaves)
        spot = tree.sa[leaf + step - 1]
        tail = np.repeat(length[own] - size, leaves)
        kind = np.repeat(at[own], leaves)
        inside = spot + tail < len(tree.sa)
        same = inside & (names[np.where(inside, spot + tail, -1)] == names[kind + tail])
        yield spot[same], (spot + tail + size)[same], np.repeat(period[own], leaves)[same]


def runs_of(code: np.ndarray, ends: np.ndarray, least: int = 6, ratio: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all maximal runs, in order of begin, then period."""
    none = np.zeros(0, dtype=np.int64)
    if not len(code):
        return none, none, none
    tree = Tree(code, ends)
    first = borders(code, tree, blocks(tree, ends), least, ratio)
    if not len(first[0]):
        return first
    begin, stop, period = (np.concatenate(x) for x in zip(*places(tree, *vocabulary(tree, *first, least, ratio))))
    order = np.lexsort((begin, period))
    begin, stop, period = begin[order], stop[order], period[order]
    cut = np.append(True, (period[1:] != period[:-1]) | (begin[1:] > begin[:-1] + 1))
    last = np.append(np.flatnonzero(cut)[1:], len(begin)) - 1
    begin, stop, period = unique_runs(begin[cut], stop[last], period[cut])
    order = np.lexsort((period, begin))
    return begin[order], stop[order], period[order]


def kept(n: int, begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, stop, -1)
    return np.cumsum(depth[:-1]) == 0


Change = Callable[[pa.Array, Words], Words]


def _found(batch: pa.RecordBatch, least: int, ratio: int, change: Change | None):
    """Words, runs, and the text of each run."""
    own = split(batch.column("text"))
    if change is not None:
        own = change(batch.column("doc_id"), own)
    runs = runs_of(own.code, own.ends, least, ratio)
    return own, runs, np.searchsorted(own.ends, runs[0], side="right")


def _over(docs: DataFrame, run, schema: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def runs(docs: DataFrame, least: int = 6, ratio: int = 4, change: Change | None = None) -> DataFrame:
    """doc_id, start (word number), length and period of all runs."""

    def run(batches):
        for batch in small_batches(batches, BATCH):
            own, (begin, stop, period), doc = _found(batch, least, ratio, change)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (begin - own.begins[doc], stop - begin, period))], ["doc_id", "start", "length", "period"])

    return _over(docs, run, "doc_id long, start long, length long, period long")


def joined(own: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    ends = np.concatenate([[0], np.cumsum(keep)])[np.append(0, own.ends)]
    lists = pa.LargeListArray.from_arrays(pa.array(ends), own.words.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def collapse(docs: DataFrame, least: int = 6, ratio: int = 4, change: Change | None = None) -> DataFrame:
    """doc_id and text with one period left of each run, words joined by single spaces."""

    def run(batches):
        for batch in small_batches(batches, BATCH):
            own, found, _ = _found(batch, least, ratio, change)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), joined(own, kept(len(own.code), *found)).cast(pa.string())], ["doc_id", "text"])

    return _over(docs, run, "doc_id long, text string")


SUMMARY = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def summaries(docs: DataFrame, least: int = 6, ratio: int = 4, change: Change | None = None) -> DataFrame:
    """One row for each row of ``docs``: number of runs, the run of greatest exponent, digests of all runs and of the collapsed text."""

    def run(batches):
        for batch in small_batches(batches, BATCH):
            own, found, doc = _found(batch, least, ratio, change)
            begin, stop, period = found
            start, length = begin - own.begins[doc], stop - begin
            spans = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            listed = list(zip(start.tolist(), length.tolist(), period.tolist()))
            rows = []
            for k, text in enumerate(joined(own, kept(len(own.code), *found))):
                mine = listed[spans[k] : spans[k + 1]]
                best = (None, None, None)
                for one in mine:  # in order of start, then period: the first of equal exponents stays
                    if best[0] is None or one[1] * best[2] > best[1] * one[2]:
                        best = one
                lines = "".join("%d,%d,%d\n" % one for one in mine)
                milli = None if best[0] is None else 1000 * best[1] // best[2]
                rows.append((len(mine), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(memoryview(text.as_buffer())).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], SUMMARY.replace(" long", "").replace(" string", "").split(", "))

    return _over(docs, run, SUMMARY)


def planted(doc_id: pa.Array, own: Words) -> Words:
    """Of the texts whose id has a crc32 (of its digits) divisible by ten, the words from a place on become the first p of them over and over."""
    take = np.arange(len(own.code))
    for k, (d, begin, end) in enumerate(zip(doc_id.to_pylist(), own.begins.tolist(), own.ends.tolist())):
        if d is None or begin == end:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0:
            g, n = h // 10, end - begin
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            take[begin + a : end] = begin + a + np.arange(n - a) % p
    return rewritten(own, take)
