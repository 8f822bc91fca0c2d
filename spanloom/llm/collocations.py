"""Phrases of words that stand together more often than by chance, counted through sorted id n-grams.

1. ``encode``: blocks of about 4 MB of texts of one language, each with its distinct words,
   their counts and the places of words and breaks (``.,;:!?``, line ends, ends of texts) as
   numbers of the block's own. Written once.
2. ``dictionary``: counts of all words of all blocks, summed by Spark; words that are frequent
   get dense 32-bit numbers. Each block's words are joined to them; pieces break at all others.
3. ``count``, for phrases of 2, 3, ... words: each block packs its n-grams into keys of fixed
   width, 4 bytes an id, and counts its own, sorted; keys go to ranges whose bounds come from a
   sample of keys (which places work, no result). In each range the keys are sorted by radix,
   16 bits at a time, and counted by run length. Each block learns which of its n-grams are
   frequent, by a bit for each of them in order; only those may be a part of a longer one.
4. ``collocations``: of the cuts of a phrase the lowest score counts; phrases that longer ones
   explain are left out; the best of each language stay.

A range gets at most one row from each block and range, so a phrase that makes up a third of
all text is still one key a block. No dictionary is broadcast; a block's share of it travels
to the block. Ranges grow in number with the text, so their size does not.

Cases: a null text is the empty text; a null language is ``und``, together with texts that say
so. Rows count as often as they stand there, doc_id is not read, nor are other columns. Empty
tables, or tables without a frequent phrase, give no rows. Only A-Z are lower-cased.
Counts below 10^15 and fewer than 2^32 frequent words are exact; more words are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import keep, small_batches, text_of

BATCH = 4 << 20
BREAKS = r"[.,;:!?\x0A-\x0D]+"
BREAK = "."


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, with their count before them."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(cell: bytes, kind) -> np.ndarray:
    size = int.from_bytes(cell[:8], "little")
    return np.frombuffer(pa.decompress(cell[8:], size, codec="zstd", asbytes=True), dtype=kind)


def words_and_breaks(texts: pa.Array) -> pa.Array:
    """The words of all texts in turn, lower-cased, with ``.`` where a piece ends."""
    wide = pa.large_string()
    low = pc.binary_join_element_wise(pc.ascii_lower(texts.cast(wide)), pa.scalar(BREAK, wide), pa.scalar("", wide))
    flat = pc.ascii_split_whitespace(pc.replace_substring_regex(low, BREAKS, f" {BREAK} ")).flatten()
    return flat.filter(pc.not_equal(pc.binary_length(flat), 0))


def encode(docs: DataFrame) -> DataFrame:
    """block, lang, words, counts and places (packed 32-bit numbers into words from 1; 0 is a break), written to the shared folder."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, BATCH):
            langs = batch.column("lang").dictionary_encode()
            for k in range(len(langs.dictionary)):
                flat = words_and_breaks(batch.column("text").filter(pc.equal(langs.indices, k))).dictionary_encode()
                place = flat.indices.to_numpy().astype(np.int64)
                words, counts = flat.dictionary, np.bincount(place, minlength=len(flat.dictionary))
                stop = pc.index(words, pa.scalar(BREAK, words.type)).as_py()
                number = np.arange(1, len(words) + 1)
                number[stop:] -= 1
                number[stop] = 0
                own = np.arange(len(words)) != stop
                cells = [[f"{part}-{made}"], [langs.dictionary[k].as_py()], [words.filter(pa.array(own)).to_pylist()], [counts[own]], [packed(number[place].astype(np.uint32))]]
                kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["block", "lang", "words", "counts", "places"])
                made += 1

    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    return keep(own.mapInArrow(run, "block string, lang string, words array<string>, counts array<long>, places binary"), "blocks")


def dictionary(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Frequent words (lang, word, id from 1, f), written, and the number of all words of each language (lang, n)."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    sums = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    # where a row was written is stored with it: part of the write, place in the part
    stored = keep(sums.where(F.col("f") >= least).withColumn("_row", F.monotonically_increasing_id()), "words").withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("_part").agg(F.count("*").alias("_rows"))  # one row for each part of the write
    offsets = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = stored.join(F.broadcast(offsets), "_part").select("lang", "word", (F.col("_before") + F.col("_at") + 1).alias("id"), "f")
    return numbered, totals


def with_ids(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """block and ids: the dictionary's number at each place, 0 at breaks and where a word is not frequent; written to the shared folder."""
    each = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"])
    own = each.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("known"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, many, places, known = (batch.column(c)[k] for c in ("block", "many", "places", "known"))
                number = np.zeros(many.as_py() + 1, dtype=np.uint32)
                number[np.asarray(known.values.field("at")).astype(np.int64) + 1] = np.asarray(known.values.field("id"))
                cells = [block.as_py()], [packed(number[unpacked(places.as_py(), np.uint32)])]
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.string()), pa.array(cells[1], pa.binary())], ["block", "ids"])

    joined = blocks.select("block", F.size("words").alias("many"), "places").join(own, "block")
    return keep(joined.mapInArrow(run, "block string, ids binary"), "ids")


def ngrams(ids: np.ndarray, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block as rows of ids, sorted, and their counts; n is 2 and one more for each array in ``frequent``, which says of the block's n-grams of 2, 3, ... words, in order, which are frequent."""
    prefix, good = ids.astype(np.uint64), ids > 0
    rows = None
    for n in range(2, len(frequent) + 3):
        good = good[:-1] & good[1:]  # both parts that lack one word are frequent
        key = prefix[:-1][good] << np.uint64(32) | ids[n - 1 :][good].astype(np.uint64)
        final = n == len(frequent) + 2
        distinct, *which, counts = np.unique(key, return_inverse=not final, return_counts=True)
        head, last = distinct >> np.uint64(32), (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
        rows = np.concatenate([head.astype(np.uint32)[:, None] if rows is None else rows[head.astype(np.int64)], last], axis=1)
        if final:
            return rows, counts
        if len(frequent[n - 2]) != len(rows):
            raise ValueError(f"{len(rows)} n-grams, marks for {len(frequent[n - 2])}")
        prefix = np.zeros(len(good), dtype=np.uint64)
        prefix[good] = which[0].astype(np.uint64)
        good[good] = frequent[n - 2][which[0]]


def keys_of(rows: np.ndarray) -> np.ndarray:
    """Ids of a row as one key of fixed width, big-endian, which sorts as the ids do."""
    n = rows.shape[1]
    return np.frombuffer(rows.astype(">u4").tobytes(), dtype=f"S{4 * n}")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys of fixed width: stable passes over 16 bits, the last ones first."""
    digits = np.frombuffer(keys.tobytes(), dtype=">u2").reshape(len(keys), -1)
    order = np.arange(len(keys))
    for k in range(digits.shape[1] - 1, -1, -1):
        digit = digits[:, k].astype(np.uint16)
        if digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _marks(cells) -> list[np.ndarray]:
    """Whether each n-gram of a block is frequent, from the bits of its ranges in order."""
    return np.concatenate([np.unpackbits(np.frombuffer(c["bits"], np.uint8), count=c["many"]).astype(bool) for c in sorted(cells, key=lambda c: c["bucket"])] or [np.zeros(0, bool)])


def _own_ngrams(batch: pa.RecordBatch, k: int, marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return ngrams(unpacked(batch.column("ids")[k].as_py(), np.uint32), [_marks(batch.column(m)[k].as_py() or []) for m in marks])


def bounds(blocks: DataFrame, marks: list[str], buckets: int, sampled: int = 16, each: int = 4096) -> np.ndarray:
    """Keys that cut the n-grams into ranges, from evenly spaced keys of ``sampled`` blocks."""
    width = 4 * (len(marks) + 2)
    some = blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(sampled)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, _ = _own_ngrams(batch, k, marks)
                keys = keys_of(rows)[:: max(1, len(rows) // each)]
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], ["keys"])

    met = blocks.join(F.broadcast(some), "block").mapInArrow(run, "keys binary").collect()
    every = np.sort(np.frombuffer(b"".join(bytes(r["keys"]) for r in met), dtype=f"S{width}"))
    return every[np.linspace(0, len(every), buckets + 1)[1:-1].astype(int)] if len(every) else every


def count(blocks: DataFrame, marks: list[str], least: int, buckets: int) -> DataFrame:
    """Phrases of one word more than the last, as rows without a block (keys, counts), and bits for each block and range; written to the shared folder."""
    cuts = bounds(blocks, marks, buckets)
    width = 4 * (len(marks) + 2)

    def deal(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, counts = _own_ngrams(batch, k, marks)
                keys = keys_of(rows)
                at = [0, *np.searchsorted(keys, cuts, side="left").tolist(), len(keys)]
                cells = [(b, i, j) for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
                columns = keys.view(np.uint8).reshape(len(keys), width) if len(keys) else None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("block")[k].as_py()] * len(cells), pa.string()),
                        pa.array([b for b, _, _ in cells], pa.int32()),
                        pa.array([packed(columns[i:j].T) for _, i, j in cells], pa.binary()),
                        pa.array([packed(counts[i:j].astype(np.uint32)) for _, i, j in cells], pa.binary()),
                    ],
                    ["block", "bucket", "keys", "counts"],
                )

    def reduce(batches):
        blocks_, ids, keys, counts = [], [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                own = unpacked(batch.column("keys")[k].as_py(), np.uint8).reshape(width, -1).T
                blocks_.append(batch.column("block")[k].as_py())
                ids.append(batch.column("bucket")[k].as_py())
                keys.append(np.frombuffer(np.ascontiguousarray(own).tobytes(), dtype=f"S{width}"))
                counts.append(unpacked(batch.column("counts")[k].as_py(), np.uint32))
        if not keys:
            return
        sizes = list(map(len, keys))
        every, many = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        del keys, counts
        order = radix_order(every)
        ordered = every[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(many[order], begin)
        frequent = total >= least
        bit = np.zeros(len(every), dtype=bool)
        bit[order] = np.repeat(frequent, np.diff(np.append(begin, len(every))))
        found = ordered[begin][frequent]
        listed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
        ends = np.cumsum(sizes)
        none = [None] * len(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*blocks_, None], pa.string()),
                pa.array([*ids, ids[0]], pa.int32()),
                pa.array([*(np.packbits(bit[e - s : e]).tobytes() for s, e in zip(sizes, ends)), None], pa.binary()),
                pa.array([*sizes, None], pa.int32()),
                pa.concat_arrays([pa.array(none, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), listed)]),
                pa.array([*none, total[frequent]], pa.list_(pa.int64())),
            ],
            ["block", "bucket", "bits", "many", "keys", "counts"],
        )

    dealt = blocks.mapInArrow(deal, "block string, bucket int, keys binary, counts binary").repartitionById(buckets, "bucket")
    return keep(dealt.mapInArrow(reduce, "block string, bucket int, bits binary, many int, keys array<binary>, counts array<long>"), "ngrams")


def frequent_phrases(blocks: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """key (4 bytes an id) and a (how often) of all frequent phrases of 2 to ``longest`` words."""
    spark = blocks.sparkSession
    own = with_ids(blocks, words)
    size = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")).first().n or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 22)
    found, marks = None, []
    for n in range(2, longest + 1):
        made = count(own, marks, least, buckets)
        new = made.where("block is null").select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.counts").alias("a"))
        found = new if found is None else found.unionByName(new)
        if n < longest:
            marks.append(f"marks{n}")
            bits = made.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "many", "bits")).alias(marks[-1]))
            own = own.join(bits, "block", "left")
    return found


def part(start, n_ids) -> F.Column:
    """Ids of a key, from the one at ``start`` (from 0) on."""
    return F.substring(F.col("key"), start * 4 + 1, n_ids * 4)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """key, a and the lowest-scoring cut: score, l, r."""
    known = phrases.unionByName(words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), F.col("f").alias("a")))
    size = F.length("key") / 4
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size.cast("int") - 1))).select("key", "a", "k", part(F.lit(0), F.col("k")).alias("head"), part(F.col("k"), size.cast("int") - F.col("k")).alias("tail"))
    l, r = known.select(F.col("key").alias("head"), F.col("a").alias("l")), known.select(F.col("key").alias("tail"), F.col("a").alias("r"))
    exact = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    each = cuts.join(l, "head").join(r, "tail").withColumn("score", F.expr(exact))
    return each.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("key", "a", "c.score", "c.l", "c.r")


def unexplained(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that stand in no longer one with at least ``percent`` of their number."""
    size = (F.length("key") / 4).cast("int")
    parts = candidates.where(size > 2).select("a", "key", F.explode(F.sequence(F.lit(2), size - 1)).alias("n")).withColumn("at", F.explode(F.sequence(F.lit(0), size - F.col("n"))))
    most = parts.groupBy(part(F.col("at"), F.col("n")).alias("key")).agg(F.max("a").alias("_longer"))
    return candidates.join(most, "key", "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * percent)).drop("_longer")


def spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Adds lang and phrase, the words joined by spaces."""
    size = (F.length("key") / 4).cast("int")
    places = candidates.select("key", F.explode(F.sequence(F.lit(0), size - 1)).alias("at")).select("key", "at", F.conv(F.hex(part(F.col("at"), F.lit(1))), 16, 10).cast("long").alias("id"))
    one = places.join(words.select("id", "lang", "word"), "id").groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return candidates.join(one, "key")


def best(rows: DataFrame, by: list[str], order: list, most: int, salts: int = 32) -> DataFrame:
    """The first ``most`` rows of each group with their rank; groups are dealt out by a hash first, so no task sorts a whole one."""
    first = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    few = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(salts))).withColumn("_nth", first).where(F.col("_nth") <= most).drop("_salt", "_nth")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    blocks = encode(docs)
    words, totals = dictionary(blocks, least)
    if (words.agg(F.max("id").alias("id")).first().id or 0) > 0xFFFFFFFF:
        raise ValueError("more frequent words than a 32-bit number tells apart")
    candidates = keep(scored(frequent_phrases(blocks, words, longest, least), words), "phrases")
    rows = spelled(unexplained(candidates, percent), words)
    top = best(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), "phrase"], most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
