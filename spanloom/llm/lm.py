"""Language-model scores of whole texts, beside a word-count base score.

Words are counted over all training documents: each Arrow batch yields its distinct words
with their numbers, Spark sums them by word. Subword counts follow from the words. A second
pass cuts each text once and stores its ids. It also adds up the base score of the words in a
broadcast head, the most frequent ones, ``head`` at most; each document's other words reach a
join with the counts, once for each word, so no frequent word is dealt to one task.

All further passes read the ids. One counts which id follows which, over all training documents.
The rows, classes, biases and the table of classes that follow an id come from the counts. The
network's weights are learned on the executors in ``rounds``, from windows of each document: all of
them, or one in ``every``, one at least, each in one round. Each worker goes through its
share of a round's windows from the same start, Spark sums what they changed, and the mean is
the start of the next round. What reaches the driver has the size of the network. The last pass
scores all texts with it.

Cases: a null or empty text is its end alone. Rows without a doc_id are scored, have a null
held_out and are not learned from. Rows that repeat a doc_id keep a row each. Without
training documents the counts are zero. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import attention
from spanloom.llm.attention import Model, subwords
from spanloom.llm.common import FILES_GO, give_back, hold_freed, keep, setting, small_batches, text_of

#: Bytes of texts, and of ids, that are handled at a time.
BATCH, IDS = 12 << 20, 2 << 20
#: Rows of the tables that stand for neighbours when classes are made; windows a worker learns from in a round, and workers.
CONTEXTS, SHARE, WORKERS = 128, 16384, 1024
GATHERED = "code long, n long, round int, place long, windows binary"
CUT = "place long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_ids long, ids binary, word string, n long"
SCORED = "place long, doc_id long, n_tokens long, known long, base double, score double"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, ends = split.flatten(), np.cumsum(np.asarray(pc.list_value_length(split)))
    there = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(there)])
    coded = flat.filter(pa.array(there)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(before[ends], prepend=0) if len(ends) else ends


def bytes_of(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def count_words(texts: DataFrame) -> DataFrame:
    """word and n over all texts."""

    def run(batches):
        for batch in small_batches(batches, BATCH):
            words, codes, _ = words_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_ids(counts: DataFrame, vocabulary: str) -> dict[int, int]:
    """How often each id stands in all counted words: as many numbers as the vocabulary has entries, at most."""

    def run(batches):
        cut = subwords(vocabulary)
        total = np.zeros(cut.size, dtype=np.int64)
        for batch in batches:
            ids, lengths = cut.encode(bytes_of(batch.column("word")))
            np.add.at(total, ids, np.repeat(np.asarray(batch.column("n")), lengths))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return {r.id: r.n for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def head_words(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words, ``most`` at most, and their counts: all above a count that a histogram gives."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level)
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r.level
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    found = counts.where(level >= least).toArrow().combine_chunks()
    return pa.concat_arrays(found["word"].chunks).cast(pa.string()), found["n"].to_numpy()


def sequence(cut, words: list[bytes], codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, each with its end id, laid end to end, and the number of each text's ids."""
    flat, lengths = cut.encode(words)
    flat, lengths = np.append(flat, 0).astype(kind_of(cut.size)), np.append(lengths, 1)
    ends = np.cumsum(sizes)
    codes = np.insert(codes, ends, len(words))
    own = lengths[codes]
    number = np.int32 if (total := int(own.sum())) < 1 << 31 else np.int64
    shift = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(own) - own)
    at = np.repeat(shift.astype(number), own)
    at += np.arange(total, dtype=number)
    return flat[at], np.add.reduceat(own, np.concatenate([[0], ends[:-1] + np.arange(1, len(ends))])) if len(ends) else own[:0]


def stored_ids(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The ids of each text as bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
    wide = offsets[-1] >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(ids)])


def ids_in(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``stored_ids``."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(kind_of(size))
    lengths = np.diff(offsets) // kind.itemsize
    return np.frombuffer(data, kind, int(lengths.sum()), int(offsets[0])) if len(column) else np.zeros(0, kind), lengths


def cut_texts(docs: DataFrame, head: tuple[pa.Array, np.ndarray], known_end: int, tokens: int, types: int, vocabulary: str) -> DataFrame:
    """A row for each document, with its ids and with base sums over its head words and its end, and (word not null) one for each of its other words."""
    common = docs.sparkSession.sparkContext.broadcast(head)
    whole = tokens + 0.5 * (types + 1)
    end = math.log10((known_end + 0.5) / whole)
    names = [x.split()[0] for x in CUT.split(", ")]

    def run(batches):
        cut, (frequent, counts) = subwords(vocabulary), common.value
        # the last is for words that are not in the head
        counts, chances = np.append(counts, -1), np.append(np.log10(counts + 0.5), 0) - math.log10(whole)
        place = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, BATCH):
            distinct, codes, sizes = words_of(batch.column("text"))
            n, types = len(sizes), max(1, len(distinct))
            places = place + np.arange(n)
            place += n
            ids, lengths = sequence(cut, bytes_of(distinct), codes, sizes)
            found = np.asarray(pc.fill_null(pc.index_in(distinct.cast(frequent.type), frequent), len(frequent)))[codes]
            of = np.repeat(np.arange(n), sizes)
            common_word = found < len(frequent)
            base = np.bincount(of[common_word], chances[found[common_word]], minlength=n) + end
            known = np.bincount(of[common_word], minlength=n) + (known_end > 0)
            none = pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())
            columns = [pa.array(places), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(lengths), stored_ids(ids, lengths).cast(pa.binary()), *none]
            yield pa.RecordBatch.from_arrays(columns, names)
            pairs, times = np.unique(of[~common_word] * types + codes[~common_word], return_counts=True)
            nulls = (pa.nulls(len(pairs), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(places[pairs // types]), *nulls, distinct.take(pa.array(pairs % types)), pa.array(times)], names)

    return docs.mapInArrow(run, CUT)


def gather(texts: DataFrame, row: np.ndarray, vocabulary: str, every: int, rounds: int, only: int | str | None = None) -> DataFrame:
    """code and n: how often the rows code // R and code % R follow each other, R rows in all; or (code null) n windows to learn from in a round, as ids of ``kind_of``. ``texts`` has ``ids``, or ``text`` to cut. ``only``: the windows of one round alone, or "pairs"."""
    shared = texts.sparkSession.sparkContext.broadcast(row)
    size, column = int(row.max()) + 1, "ids" if "ids" in texts.columns else "text"
    wanted = [r for r in range(rounds) if only in (None, r)]

    def counted(table):
        codes = np.flatnonzero(table)
        n = table[codes].astype(np.int64)
        table[codes] = 0
        for b in range(0, len(codes), 1 << 16):
            part = n[b : b + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(codes[b : b + len(part)]), pa.array(part), *(pa.nulls(len(part), t) for t in (pa.int32(), pa.int64(), pa.binary()))], GATHERED_NAMES)

    def run(batches):
        hold_freed()
        cut, row = subwords(vocabulary), shared.value
        place, kind = TaskContext.get().partitionId() << 40, np.dtype(kind_of(cut.size))
        table, seen = np.zeros(size * size, np.uint32), 0  # memory that no pair reaches is never taken
        for batch in small_batches(batches, BATCH if column == "text" else IDS, column):
            if column == "ids":
                ids, lengths = ids_in(batch.column("ids"), cut.size)
            else:
                words, codes, sizes = words_of(batch.column("text"))
                ids, lengths = sequence(cut, bytes_of(words), codes, sizes)
            if only in (None, "pairs"):
                if seen + len(ids) >= 1 << 32:
                    yield from counted(table)
                    seen = 0
                seen += len(ids)
                own = row[ids].astype(np.int64)
                code = np.append(0, own[:-1]) * size  # each text ends with the end, which the first row is
                code += own
                np.add.at(table, code, np.uint32(1))
            of, at = attention.window_starts(lengths)
            number = at // attention.STEP
            mixed = np.asarray(pc.fill_null(batch.column("doc_id"), 0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            first = mixed.astype(np.int64) % np.minimum(every, -(-lengths // attention.STEP))
            some = number % every == first[of]
            turn = np.where(some, (mixed.astype(np.int64)[of] // every + number // every) % rounds, -1)
            padded = np.append(ids, np.iinfo(kind).max).astype(kind)
            for r in wanted:
                mine = np.flatnonzero(turn == r)
                for b in range(0, len(mine), 2048):
                    those = mine[b : b + 2048]
                    part = padded[attention.windows(lengths, of[those], at[those])]
                    columns = [pa.nulls(1, pa.int64()), pa.array([len(part)]), pa.array([r], pa.int32()), pa.array([place]), pa.array([part.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, GATHERED_NAMES)
                    place += 1
        if seen:
            yield from counted(table)

    return texts.mapInArrow(run, GATHERED)


GATHERED_NAMES = [x.split()[0] for x in GATHERED.split(", ")]


def kind_of(size: int) -> str:
    """How ids are stored: all ones is none."""
    return "<u2" if size < 1 << 16 else "<u4"


def windows_in(stored: bytes, size: int) -> np.ndarray:
    ids = np.frombuffer(stored, kind_of(size)).reshape(-1, attention.LEAD + 1 + attention.STEP)
    return np.where(ids == np.iinfo(ids.dtype).max, -1, ids.astype(np.int64))


def pair_counts(pairs: DataFrame, size: int) -> np.ndarray:
    """How often each row follows each row: at most as many numbers as the tables have rows, squared."""
    table = np.zeros(size * size, dtype=np.float32)
    with setting(pairs.sparkSession, FILES_GO, "true"):
        found = pairs.toArrow()
    for batch in found.to_batches():
        table[np.asarray(batch.column("code"))] = np.asarray(batch.column("n"))
    return table.reshape(size, size)


def learned(model: Model, stored: DataFrame, windows: int, rate: float, batch: int, size: int) -> Model:
    """The model after one round over stored windows: the mean of what workers change."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast(attention.without_pairs(model))
    schema = "name string, first int, change binary"

    def work(batches):
        hold_freed()
        own = attention.copy_of(shared.value)
        attention.learn(own, (windows_in(s, size) for b in batches for s in b.column("windows").to_pylist()), rate, batch)
        for name, first, change in attention.changes(shared.value, own):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int32()), pa.array([change.tobytes()], pa.binary())], ["name", "first", "change"])
        give_back()

    def add(batches):
        key, total = None, None
        for b in batches:
            for k in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k[:2] != key:
                    if key is not None:
                        yield summed(key, total)
                    key, total = k[:2], np.zeros(len(k[2]) // 4)
                total += np.frombuffer(k[2], "<f4")
        if key is not None:
            yield summed(key, total)

    def summed(key, total):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["name", "first", "change"])

    workers = max(1, min(WORKERS, -(-windows // SHARE)))
    changed = stored.repartition(workers, "place").sortWithinPartitions("place").select("windows").mapInArrow(work, schema)
    with setting(spark, FILES_GO, "true"):
        sums = changed.repartition("name", "first").sortWithinPartitions("name", "first").mapInArrow(add, schema).collect()  # of the network's size
    after, width = attention.copy_of(model), {k: v.shape[1] + 1 for k, v in attention.numbers(model).items()}
    for r in sums:
        attention.add_changes(after, r.name, r.first, np.frombuffer(r.change, "<f8").reshape(-1, width[r.name]))
    shared.destroy()
    return after


def train(texts: DataFrame, counts: DataFrame, documents: int, vocabulary: str, most_rows: int = 4096, every: int = 1, rounds: int = 4, rate: float = 0.1, batch: int = 96) -> Model:
    """A network that has learned from ``texts`` (doc_id, n_ids, ids)."""
    size = subwords(vocabulary).size
    totals = np.zeros(size)
    for i, n in count_ids(counts, vocabulary).items():
        totals[i] = n
    totals[0] = documents
    _, row = attention.rows_of(totals, most_rows)
    rows = int(row.max()) + 1
    pairs = gather(texts, row, vocabulary, every, rounds, "pairs").groupBy("code").agg(F.sum("n").alias("n"))
    follow = pair_counts(pairs, rows)
    contexts = min(CONTEXTS, rows)
    group = attention.classes(totals, most_rows, follow[:contexts].T.astype(float), follow[:, :contexts].astype(float))
    model = attention.start(totals, most_rows, group, follow)
    del follow
    windows = texts.agg(F.sum(F.ceil(F.ceil(F.col("n_ids") / attention.STEP) / every))).first()[0] or 0
    for r in range(rounds if windows else 0):
        model = learned(model, gather(texts, row, vocabulary, every, rounds, r), -(-windows // rounds), rate * (1 - 0.9 * r / rounds), batch, size)
    model.past = {}  # not needed to score
    return model


def score_rows(cut: DataFrame, model: Model, vocabulary: str) -> DataFrame:
    """The documents of ``cut_texts`` with their scores."""
    network = cut.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches):
        hold_freed()
        size, model = subwords(vocabulary).size, network.value
        for batch in small_batches(batches, IDS, "ids"):
            ids, lengths = ids_in(batch.column("ids"), size)
            values = model.log_chance(ids, lengths) / math.log(10)
            score = np.bincount(np.repeat(np.arange(len(lengths)), lengths), values, minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:-1]), pa.array(score)], names)

    return cut.select(*names[:-1], "ids").mapInArrow(run, SCORED)


def score(docs: DataFrame, vocabulary: str, head: int = 1 << 18, **rule) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)):
        return scored(docs, vocabulary, head, **rule)


def scored(docs: DataFrame, vocabulary: str, head: int, **rule) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("held_out", held_out())
    texts = own.where("not held_out")
    counts = keep(count_words(texts), "words")
    documents = texts.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types")).first()
    tokens, types = sums.n + documents, sums.types + (documents > 0)
    cut = keep(cut_texts(own, head_words(counts, head), documents, tokens, types, vocabulary), "cut")
    whole_texts = cut.where("word is null")
    model = train(whole_texts.where("not held_out").select("doc_id", "n_ids", "ids"), counts, documents, vocabulary, **rule)
    rows = keep(score_rows(whole_texts, model, vocabulary), "scores")
    whole = tokens + 0.5 * (types + 1)
    rest = cut.where("word is not null").select("place", "word", "n").join(counts.withColumnRenamed("n", "c"), "word", "left")
    rest = rest.groupBy("place").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(math.log10(whole)))).alias("more"),
    )
    every = rows.join(rest, "place", "left")
    return every.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
