"""Removal of repeated byte strings by prefix-free parsing.

A window is a string of ``window`` bytes (100) inside one document. Its trigger is the gram
of ``gram`` bytes with the least rolling hash in it, the leftmost of equals; every window has
one, and it depends on the window's bytes alone. A phrase is the text under a run of windows
with the same trigger, so phrases overlap by one byte less than a window, and each window
lies in exactly one phrase. Long repeats parse into the same phrases, so the dictionary of
distinct phrases is small where a corpus repeats itself.

The parse is sorted by trigger, phrase and place in the corpus. Of the occurrences of one
phrase all but the first are repeats as a whole. Windows of different phrases can be equal
only where these share a trigger. Only such entries of the dictionary are taken apart: their
suffixes of at least one window, cut at the window's length, are sorted (the suffix array of
the dictionary to that depth), and of equal ones, in the order of the first occurrences in
the parse, all but the first are repeats. Both steps together mark every window that starts
earlier in the corpus too. The corpus itself is never sorted by suffix.

Phrases that repeat within a batch of one task are settled there and reach the shuffle as
spans dealt out by document, so a passage that a third of all documents share adds one row
for each batch. A trigger with more than ``crowd`` dictionary entries, such as a line that
many documents hold in other surroundings, is not settled in one task either: its suffixes
are dealt out by their content. What a task holds is a batch, a document or a crowd.

Cases: a null text is the empty text. Order is by doc_id. Rows without a doc_id take no part.
Rows that repeat a doc_id with the same text are one document, reported as often as they
occur; those with other texts are documents of their own, in the order of a hash of the text. Columns other than doc_id and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import keep, small_batches, text_of

WINDOW, GRAM = 100, 32
U = np.uint64
PIECE = 1 << 20
#: n: the number of windows of a phrase, or minus the end of a span of repeats that its own batch has settled.
PARSE = "route long, phrase long, doc_id long, start long, n long"
FOUND = "doc_id long, start long, stop long, gram long"
ENTRY = "gram long, doc_id long, start long, content binary"
SUFFIX = "doc_id long, start long, stop long, a long, b long"


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


TABLE = byte_table(9), byte_table(10)
#: Odd multipliers for each doubling of the length, made by a rule.
MULTIPLY = [U((0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 | 1) for k in range(16)]


def rolling(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of ``length`` bytes, by doubling: that of 2m bytes is made of two of m."""
    now, size, at, out = TABLE[which][data], 1, 0, None
    left, k = length, 0
    while True:
        if left & 1:
            if out is None:
                out, at = now, size
            else:
                n = len(now) - at
                out = out[:n] * MULTIPLY[k + which] + now[at : at + n]
                out ^= out >> U(31)
                at += size
        left >>= 1
        if not left:
            return out
        n = len(now) - size
        if n <= 0:
            return now[:0]
        now = now[:n] * MULTIPLY[k + which] + now[size : size + n]
        now ^= now >> U(29)
        size, k = size * 2, k + 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(data: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and trigger hash of each phrase of one text."""
    starts, counts, triggers = [], [], []
    text = np.frombuffer(data, dtype=np.uint8)
    windows = len(text) - window + 1
    for base in range(0, windows, PIECE):
        own = text[base : base + PIECE + window - 1]
        grams = rolling(own, gram)
        keyed = (grams * U(0xD6E8FEB86659FD93)) >> U(24) << U(24) | np.arange(len(grams), dtype=U)
        at = (sliding_least(keyed, window - gram + 1) & U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        starts.append(base + first)
        counts.append(np.diff(np.concatenate([first, [len(at)]])))
        triggers.append(grams[at[first]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(starts or [none]), np.concatenate(counts or [none]), np.concatenate(triggers or [none.astype(U)])


def spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each document; touching ones become one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new) - 1
    lift = group * (int(stop.max()) + 1)  # so that one running maximum serves all documents
    reach = np.maximum.accumulate(stop + lift) - lift
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last]


def first_of_runs(new: np.ndarray) -> np.ndarray:
    """For each row the index of its run's first row."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def no_longs(n: int) -> pa.Array:
    return pa.nulls(n, pa.int64())


def parse(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The phrases of all documents, routed by trigger, and spans of repeats found within a batch, routed by document."""

    def run(batches):
        for batch in small_batches(batches):
            parts = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                start, n, trigger = phrases(data, window, gram)
                if len(start):
                    ends = (start + n + window - 1).tolist()
                    phrase = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), ends)]
                    parts.append((np.full(len(start), doc_id), start, n, trigger, np.array(phrase, dtype=U)))
            if not parts:
                continue
            doc, start, n, trigger, phrase = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((start, doc, phrase, trigger))
            doc, start, n, trigger, phrase = (x[order] for x in (doc, start, n, trigger, phrase))
            new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])])
            lead = first_of_runs(new)
            again = (doc != doc[lead]) | (start != start[lead])
            d, a, b = spans(doc[again], start[again], start[again] + n[again] + window - 1)
            yield batch_of(PARSE, trigger[new].view(np.int64), phrase[new].view(np.int64), doc[new], start[new], n[new])
            yield batch_of(PARSE, (d.astype(U) * MULTIPLY[1]).view(np.int64), d, d, a, -b)

    return docs.select("doc_id", "text").mapInArrow(run, PARSE)


def settle(parsed: DataFrame, window: int) -> DataFrame:
    """Repeats, as spans of documents, and (with their trigger) the first occurrences of phrases whose trigger other phrases share."""

    def run(batches):
        state = None  # the first occurrence of the last phrase, and whether its trigger is known to be shared
        for batch in batches:
            gram, phrase, doc, start, n = (np.asarray(c) for c in batch.columns)
            whole = n < 0
            yield batch_of(FOUND, doc[whole], start[whole], -n[whole], no_longs(int(whole.sum())))
            gram, phrase, doc, start, n = (x[~whole] for x in (gram, phrase, doc, start, n))
            if not len(gram):
                continue
            shared = False
            if state is not None:
                gram, phrase, doc, start, n = (np.concatenate([[s], x]) for s, x in zip(state[:5], (gram, phrase, doc, start, n)))
                shared = state[5]
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new = new_gram | np.concatenate([[True], phrase[1:] != phrase[:-1]])
            lead = first_of_runs(new)
            again = (doc != doc[lead]) | (start != start[lead])
            d, a, b = spans(doc[again], start[again], start[again] + n[again] + window - 1)
            yield batch_of(FOUND, d, a, b, no_longs(len(d)))
            of = np.cumsum(new_gram) - 1
            many = np.bincount(of[new]) > 1
            many[0] |= shared
            mixed = new & many[of]
            if shared:
                mixed[0] = False  # told before
            yield batch_of(FOUND, doc[mixed], start[mixed], start[mixed] + n[mixed] + window - 1, gram[mixed])
            k = lead[-1]
            state = (gram[k], phrase[k], doc[k], start[k], n[k], bool(many[of[k]]))

    return parsed.repartition("route").sortWithinPartitions("route", "phrase", "doc_id", "start").mapInArrow(run, FOUND)


def intervals(column: pa.Array, k: int, *names: str) -> list[np.ndarray]:
    """Fields of the k-th row's array of intervals; none for null."""
    value = column[k]
    if not value.is_valid:
        return [np.zeros(0, dtype=np.int64) for _ in names]
    return [np.asarray(value.values.field(name)) for name in names]


def per_document(rows: DataFrame, *names: str) -> DataFrame:
    """doc_id and its intervals as one array; a document has no more of them than bytes."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("parts"))


def dictionary(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed entries of the dictionary with their content."""

    def run(batches):
        for batch in small_batches(batches):
            out = []
            parts = batch.column("parts")
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                data = text.encode("utf-8", "surrogatepass")
                for a, b, gram in set(zip(*(x.tolist() for x in intervals(parts, k, "start", "stop", "gram")))):
                    out.append((gram, doc_id, a, data[a:b]))
            if out:
                gram, doc, start, content = zip(*out)
                yield batch_of(ENTRY, np.array(gram, dtype=np.int64), np.array(doc, dtype=np.int64), np.array(start, dtype=np.int64), pa.array(content, pa.binary()))

    return docs.join(per_document(mixed, "start", "stop", "gram"), "doc_id").select("doc_id", "text", "parts").mapInArrow(run, ENTRY)


def sorted_suffixes(doc: np.ndarray, start: np.ndarray, content: list[bytes], window: int):
    """The suffixes of some entries of at least one window, sorted by their first window and place: document, place, two hashes of the window, and whether it is the first of its equals."""
    size = np.array([len(c) for c in content])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(content), dtype=np.uint8)
    n = size - window + 1
    entry = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a, b = (rolling(data, window, which)[begin[entry] + inside] for which in (0, 1))
    d, p = doc[entry], start[entry] + inside
    order = np.lexsort((p, d, b, a))
    d, p, a, b = d[order], p[order], a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return d, p, a, b, new


def compare(entries: DataFrame, window: int, crowd: int) -> DataFrame:
    """Repeats among the entries of each trigger, as spans; of crowded triggers also the first suffix of each content of a chunk, with its hashes."""

    def settled(doc, start, content, crowded: bool):
        d, p, a, b, new = sorted_suffixes(doc, start, content, window)
        lead = first_of_runs(new)
        again = (d != d[lead]) | (p != p[lead])
        x, low, high = spans(d[again], p[again], p[again] + window)
        yield batch_of(SUFFIX, x, low, high, no_longs(len(x)), no_longs(len(x)))
        if crowded:
            yield batch_of(SUFFIX, d[new], p[new], p[new] + window, a[new].view(np.int64), b[new].view(np.int64))

    def run(batches):
        held, crowded = None, None  # entries of the last trigger; a trigger whose entries are passed on
        for batch in batches:
            for k in range(0, batch.num_rows, crowd):
                some = batch.slice(k, crowd)
                now = [np.asarray(some.column(c)) for c in ("gram", "doc_id", "start")] + [np.array(some.column("content").to_pylist(), dtype=object)]
                if held is not None:
                    now = [np.concatenate(x) for x in zip(held, now)]
                gram, doc, start, content = now
                last = int(np.searchsorted(gram == gram[-1], True))
                first = int(np.searchsorted(gram != crowded, True)) if crowded is not None else 0
                if first:  # more of the crowd
                    yield from settled(doc[:first], start[:first], content[:first].tolist(), True)
                if last > first:
                    yield from settled(doc[first:last], start[first:last], content[first:last].tolist(), False)
                last = max(first, last)
                if len(gram) - last > crowd:
                    crowded = gram[-1]
                    yield from settled(doc[last:], start[last:], content[last:].tolist(), True)
                    last = len(gram)
                held = [x[last:] for x in now] if last < len(gram) else None
        if held is not None and len(held[0]):
            yield from settled(*held[1:3], held[3].tolist(), bool(crowded is not None and held[0][0] == crowded))

    return entries.repartition("gram").sortWithinPartitions("gram", "doc_id", "start").mapInArrow(run, SUFFIX)


def later_suffixes(content: DataFrame, window: int) -> DataFrame:
    """Of equal suffixes all but the first in the corpus, as spans."""
    place = F.struct("doc_id", "start")
    first = content.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    again = content.join(first.select("a", "b", "first"), ["a", "b"]).where(place != F.col("first"))
    return again.select("doc_id", "start", (F.col("start") + window).alias("stop"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = 1024) -> DataFrame:
    """doc_id and ``parts``, the intervals of bytes covered by windows that also start earlier."""
    found = keep(settle(parse(docs, window, gram), window), "parse")
    suffixes = keep(compare(dictionary(docs, found.where("gram is not null")), window, crowd), "suffixes")
    parts = [found.where("gram is null"), suffixes.where("a is null"), later_suffixes(suffixes.where("a is not null"), window)]
    every = parts[0].select("doc_id", "start", "stop")
    for part in parts[1:]:
        every = every.union(part.select("doc_id", "start", "stop"))
    return per_document(every, "start", "stop")


def without(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int]:
    """``data`` without the union of some intervals, and how many runs that union has."""
    _, low, high = spans(np.zeros(len(low), dtype=np.int64), low, np.minimum(high, len(data)))
    at, kept = 0, []
    for a, b in zip(low.tolist(), high.tolist()):
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), len(low)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_place``, a number for each pair of doc_id and text in their order: the doc_id where all its rows have one text."""
    tagged = docs.withColumns({"_place": F.col("doc_id").cast("long"), "_tag": F.xxhash64(text_of())})
    pairs = tagged.select("_place", "_tag").where("_place is not null")
    if pairs.groupBy("_place").agg(F.min("_tag").alias("a"), F.max("_tag").alias("b")).where("a != b").isEmpty():
        return tagged.drop("_tag")
    order = pairs.distinct().repartitionByRange("_place", "_tag").sortWithinPartitions("_place", "_tag")
    order = keep(order.select(F.col("_place").alias("_id"), F.col("_tag").alias("_of"), F.monotonically_increasing_id().alias("_at")), "places")
    found = tagged.join(order, (F.col("_place") == F.col("_id")) & (F.col("_tag") == F.col("_of")), "left")
    return found.withColumn("_place", F.col("_at")).select(*docs.columns, "_place")


def own_rows(docs: DataFrame) -> DataFrame:
    """doc_id (as placed), own_id (as given) and text."""
    return placed(docs.select("doc_id", "text")).where("doc_id is not null").select(F.col("_place").alias("doc_id"), F.col("doc_id").cast("long").alias("own_id"), text_of().alias("text"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes, of each document."""
    own = own_rows(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        for batch in small_batches(batches):
            rows = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                kept, n = without(data, *intervals(batch.column("parts"), k, "start", "stop"))
                rows.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield batch_of(schema, batch.column("own_id"), *(pa.array(v, t) for v, t in zip(columns, kinds)))

    return own.join(repeats(own, window, gram, crowd), "doc_id", "left").select("own_id", "text", "parts").mapInArrow(run, schema)


def cut(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = 1024) -> DataFrame:
    """The rows of ``docs``, all columns, with repeats cut from text and n_chars, where it is there, set anew.

    Bytes of a character that a cut has split go with it. A text without repeats, null too, stays as it is.
    """
    own = placed(docs)
    texts = own.where("_place is not null").select(F.col("_place").alias("doc_id"), text_of().alias("text"))
    parts = repeats(texts, window, gram, crowd).select(F.col("doc_id").alias("_place"), F.col("parts").alias("_cut"))
    joined = own.join(parts, "_place", "left").select(*docs.columns, "_cut")
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in small_batches(batches):
            columns = batch.columns
            cuts = columns.pop()
            changed = np.flatnonzero(np.asarray(cuts.is_valid()))
            if len(changed):
                texts = columns[at].to_pylist()
                counts = columns[count].to_pylist() if count is not None else None
                for k in changed.tolist():
                    data = texts[k].encode("utf-8", "surrogatepass")
                    texts[k] = without(data, *intervals(cuts, k, "start", "stop"))[0].decode("utf-8", "ignore")
                    if counts is not None:
                        counts[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                if counts is not None:
                    columns[count] = pa.array(counts, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
