"""Order-preserving packing of documents into windows by dynamic programming.

Documents follow each other in doc_id order. A window ends at a document boundary, a
sentence boundary or, inside a long stretch without either, at a hard cut. The cost of a
chain of windows is its padding (none at a full window or at a power of two of at least
``least_power``) plus a penalty in tokens for each end that is no document boundary. With
f the least cost up to a boundary, f(j) = penalty(j) + window - p(j) + min over boundaries
i within one window of f(i) + p(i): a sliding minimum, held by a monotone queue.

Spark deals the documents out by doc_id range; each range is packed as a stream in
stretches of bounded length, and the open window at the end of a stretch is carried on,
so a range has one partly filled window at its end.

Cases: a null text is the empty text, which is the end id alone. Rows without a doc_id take
no part. Rows that repeat a doc_id are packed one after the other. Columns other than
doc_id and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import give_back, small_batches, text_of, uint32
from spanloom.llm.subwords import byte_bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, ids array<int>"


@functools.lru_cache(maxsize=2)
def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether its text ends a sentence or a line."""
    vocabulary = byte_bpe(tokenizer).library.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for piece, i in vocabulary.items():  # Ċ stands for the line feed in this vocabulary
        ends[i] = piece.endswith((".", "!", "?", "Ċ"))
    return ends


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, gap: int, step: int, soft: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, 0 first, and the penalty of each."""
    is_end = ends[np.minimum(ids, len(ends) - 1)]
    is_end[:-1] &= ~is_end[1:]  # the last of several marks
    at = np.union1d(np.flatnonzero(is_end) + 1, doc_ends)
    at = np.concatenate([[0], at])
    wide = np.flatnonzero(np.diff(at) > gap)
    filled = [np.arange(at[k] + step, at[k + 1], step) for k in wide]
    penalty = np.where(np.isin(at, doc_ends), 0, soft)
    penalty[0] = 0
    if filled:
        extra = np.concatenate(filled)
        at, penalty = np.concatenate([at, extra]), np.concatenate([penalty, np.full(len(extra), hard)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


def best_cuts(at: list[int], penalty: list[int], window: int, least_power: int, final: bool) -> list[int]:
    """Window ends of least cost, ascending. Unless final, the chain may stop anywhere in the last window's reach."""
    powers = [1 << k for k in range(window.bit_length()) if least_power <= 1 << k < window]
    index = {p: k for k, p in enumerate(at)}
    cost, came, queue = [0] * len(at), [0] * len(at), deque([(0, 0)])  # of (f(i) + p(i), i)
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - window:
            queue.popleft()
        least, i = queue[0]
        least += window - p
        for power in powers:
            k = index.get(p - power)
            if k is not None and cost[k] < least:
                least, i = cost[k], k
        cost[j], came[j] = least + penalty[j], i
        value = cost[j] + p
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    last = len(at) - 1
    if not final:
        reach = range(int(np.searchsorted(at, at[-1] - window, side="right")), len(at))
        last = min(reach, key=lambda k: (cost[k] - at[k] / (8 * window), -k))  # of equal costs, the later
    cuts = []
    while last:
        cuts.append(at[last])
        last = came[last]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; holds at most one stretch and one document."""

    def __init__(self, window: int, ends: np.ndarray, stretch: int = 1 << 19, gap: int = 256, step: int = 16, soft: int = 4, hard: int = 32, least_power: int = 128):
        self.window, self.ends, self.stretch, self.least_power = window, ends, stretch, least_power
        self.rule = (gap, step, soft, hard)
        self.open: list[tuple[int, int, int, bytes]] = []  # doc_id, tokens of it before, all its tokens, ids
        self.tokens, self.windows = 0, 0

    def add(self, doc_id: int, ids: bytes):
        self.open.append((doc_id, 0, len(ids) // 4, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= self.stretch:
            yield from self.close(final=False)

    def close(self, final: bool):
        """Pieces: doc_id, start, length, doc_tokens, window number, offset in it, ids."""
        if not self.tokens:
            return
        ids = uint32(b"".join(x[3] for x in self.open))
        doc_ends = np.cumsum([len(x[3]) // 4 for x in self.open])
        at, penalty = boundaries(ids, doc_ends, self.ends, *self.rule)
        cuts = best_cuts(at.tolist(), penalty.tolist(), self.window, self.least_power, final)
        data, doc, begin = ids.tobytes(), 0, 0
        starts = np.concatenate([[0], doc_ends[:-1]]).tolist()
        stops = doc_ends.tolist()
        for cut in cuts:
            at_window = begin
            while begin < cut:
                doc_id, before, total, _ = self.open[doc]
                stop = min(cut, stops[doc])
                yield doc_id, before + begin - starts[doc], stop - begin, total, self.windows, begin - at_window, data[begin * 4 : stop * 4]
                begin = stop
                if stop == stops[doc]:
                    doc += 1
            self.windows += 1
        rest = self.open[doc:]
        if rest:
            doc_id, before, total, own = rest[0]
            used = begin - starts[doc]
            rest[0] = (doc_id, before + used, total, own[used * 4 :])
        self.open, self.tokens = rest, sum(len(x[3]) // 4 for x in rest)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, with_ids: bool = True, lean: bool = False, **rule) -> DataFrame:
    """One row for each piece, with its window's number (unique over all ranges), its offset there, and its ids if asked for.

    ``lean``: workers forget the pre-tokens they met at the end of a task, for more work and less memory.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(pieces):
        columns = list(zip(*pieces)) or [()] * 7
        ids = columns[6]
        flat = [np.frombuffer(x, dtype="<i4") for x in ids] if with_ids else [None] * len(ids)
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        values = [columns[0], columns[1], columns[2], [zlib.crc32(x) for x in ids], columns[3], columns[4], columns[5], flat]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def run(batches):
        bpe, packer = byte_bpe(tokenizer), Packer(window, sentence_ends(tokenizer), **rule)
        for batch in small_batches(batches):
            found = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode(batch.column("text"))):
                found.extend(packer.add(doc_id, ids + end))
            yield rows(found)
        yield rows(list(packer.close(final=True)))
        if lean:
            bpe.pretokens.forget()
            give_back()

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, PIECES)
    number = F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("window")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset"]
    return packed.select(*columns, *(["ids"] if with_ids else []))
