"""Near copies among texts: SimHash over five-word shingles first, then exactly all pairs whose shingle sets are similar enough.

Shingles are ``WORDS`` = 5 words (the whole text where it has fewer), hashed to 64 bits. Pairs
with a Jaccard similarity of 4/5 or more link; the links' components are the groups. Texts
with equal shingle sets are one class before anything is dealt out.

1. Each class has a SimHash fingerprint of its set. Fingerprints within two bits meet at
   anchor points of a covering code (``simhash.anchor_links``); each link found is verified on
   the sets. This joins what is nearly alike, but a pair at 4/5 differs in about ten bits and
   mostly passes it.
2. So the search is completed: under one order of all shingles, two such texts of n and m
   shingles share one among the first n - ceil(4n/5) + 1 of the one and the first
   m - ceil(4m/5) + 1 of the other. Classes are listed at these tokens. The order puts shingles
   that a sample finds in many texts last; it bears on the load alone, any order gives the same
   links. At each token every class is first tried with ``PIVOTS`` others, picked by hash.
3. What is in different components then meets at its tokens in blocks: classes of a token's
   largest component with all others, never with each other.

No pair leaves the joins of 2 and 3 unless two bounds allow it: the places of the token in the
two orders, and the symmetric difference that sketches of 512 parity bits prove. Pairs that
are left are verified on the sets. No set is stored beyond that: a text is shingled again where
its set is needed, since sets take 8 bytes for each word of the corpus. What remains quadratic is a crowd of texts near the
threshold that are alike to none: each is tried by sketch with the others of its tokens.

Cases: a null text is the empty text; texts without words have the empty set and are copies of
each other alone. Rows without a doc_id take no part. Rows that share a doc_id are texts of
their own, and stay beside each other where they are not alike. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import forget, hash_share, keep, light, small_batches, text_of
from spanloom.llm.components import connected_components
from spanloom.llm.simhash import anchor_links, crowd_links

PIVOTS, LONGS, SHORT = 6, 8, 300
SEED, WORDS = 42, 5
U = np.uint64


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=U)
    joined = b" ".join(words)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=U)
    begins = list(accumulate(map((1).__add__, map(len, words)), initial=0))
    ends = [x - 1 for x in begins[WORDS:]]
    parts = map(joined.__getitem__, map(slice, begins, ends))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=U, count=len(ends)))


def majority(sig: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, as a signed long."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(sig), 1 << 15):
        counts += np.unpackbits(sig[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(sig), bitorder="little").view("<i8")[0])


def parities(sig: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of the set's hashes falls in each of 2**bits places, packed: sets whose parities differ in k places differ in k members at least."""
    odd = np.bincount((sig >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch(sig: np.ndarray) -> np.ndarray:
    return parities(sig, 9).view("<i8")


SIGNATURES = "doc_id long, tag long, key long, fp long, size int, sketch array<long>"


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text of the rows that take part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of().alias("tag"), text_of().alias("text")).where("doc_id is not null")


def key_of(sig: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sig.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(texts: DataFrame) -> DataFrame:
    """doc_id, tag (of the text), key (of the shingle set), fp, size and sketch of each text."""

    def run(batches):
        names = [x.split()[0] for x in SIGNATURES.split(", ")]
        for batch in small_batches(batches, 4 << 20):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            sketches = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([sketch(s) for s in sets])), LONGS).cast(pa.list_(pa.int64()))
            columns = [pa.array([key_of(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), sketches]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *columns], names)

    return texts.mapInArrow(run, SIGNATURES)


def set_rows(texts: DataFrame, kind: str) -> DataFrame:
    """key and n, the size, with x: the set's hashes (kind ``sig``), or a sketch of 8192 bits of sets of more than ``SHORT`` (kind ``wide``). ``texts``: key and text."""

    def run(batches):
        for batch in small_batches(batches, 4 << 20):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            made = [s.astype("<u8").tobytes() if kind == "sig" else parities(s, 13).tobytes() if len(s) > SHORT else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array(made, pa.binary())], ["key", "n", "x"])

    return texts.select("key", "text").mapInArrow(run, "key long, n int, x binary")


def tag_of() -> Column:
    return F.xxhash64(text_of())


def common_tokens(texts: DataFrame, rows: int, some: int = 4000, least: int = 4, most: int = 1 << 17) -> np.ndarray:
    """Tokens found in ``least`` or more texts of a sample of about ``some`` of ``rows``, the most frequent last."""

    def run(batches):
        for batch in small_batches(batches, 4 << 20):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["token"])

    tokens = texts.where(hash_share("tag", some / max(1, rows))).select("text").mapInArrow(run, "token long")
    found = tokens.groupBy("token").count().where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(most).collect()
    return np.array([r.token for r in reversed(found)], dtype=np.int64).view(U)


def first_tokens(sig: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of n tokens; ``common``, ascending, come last by their rank."""
    n = len(sig)
    p = n - (4 * n + 4) // 5 + 1
    if not n or not len(common):
        return sig[:p] if n else sig
    at = np.minimum(np.searchsorted(common, sig), len(common) - 1)
    late = common[at] == sig
    first = sig[~late][:p]
    if len(first) < p:
        last = at[late]
        first = np.concatenate([first, common[last[np.argsort(rank[last])]][: p - len(first)]])
    return first


def postings(texts: DataFrame, rows: int) -> DataFrame:
    """token, key, place: each class at its first tokens, with their places in its order; a class once a batch at most."""
    by_rank = common_tokens(texts, rows)
    order = np.argsort(by_rank)
    shared = texts.sparkSession.sparkContext.broadcast((by_rank[order], order))

    def run(batches):
        common, rank = shared.value
        for batch in small_batches(batches, 4 << 20):
            sets = {key_of(sig): sig for sig in map(shingles, batch.column("text").to_pylist())}
            firsts = [first_tokens(sig, common, rank) for sig in sets.values()]
            n = np.array([len(f) for f in firsts])
            key = np.repeat(np.array(list(sets), dtype=np.int64), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(key), pa.array(place.astype(np.int32))], ["token", "key", "place"])

    return texts.select("text").mapInArrow(run, "token long, key long, place int")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets (each ascending) is 4/5 or more."""
    both = np.sort(np.concatenate([a, b]))
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) that are alike. ``classes`` names a text for each key; only those of pairs are shingled."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            near = [alike(np.frombuffer(x[k].as_py(), "<u8"), np.frombuffer(y[k].as_py(), "<u8")) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    def may(batches):  # long texts fill the short sketches
        for batch in batches:
            able = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))):
                apart = np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum(dtype=np.int64) if x and y else 0
                able.append(9 * int(apart) <= n + m)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(able, pa.bool_()))

    def of_pairs(pairs: DataFrame, kind: str) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        made.append(keep(classes.select("key", "text_of.*").join(keys, "key"), "needed"))
        found = set_rows(texts.join(light(made[-1]), ["doc_id", "tag"]), kind)
        made.append(keep(found.groupBy("key").agg(F.first("x").alias("x"), F.first("n").alias("n")), "sets"))
        return made[-1]

    made = [keep(pairs, "pairs")]  # what nothing reads once the links are written
    pairs = made[0]
    wide = of_pairs(pairs, "wide")
    both = pairs.join(wide.toDF("a", "x", "n"), "a").join(wide.toDF("b", "y", "m"), "b")
    pairs = keep(both.select("a", "b", "x", "y", "n", "m").mapInArrow(may, "a long, b long"), "able")
    sets = of_pairs(pairs, "sig").select("key", "x")
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    near = keep(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near")
    forget(*made, pairs)
    return near


def may_be_alike(x: str, y: str) -> Column:
    """What sizes, places of a shared token (the first in both orders, for some token of each alike pair) and sketches allow."""
    one, other = F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place")
    both = F.col(f"{x}.size") + F.col(f"{y}.size")
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(LONGS)))
    return (9 * F.least(one, other) >= 4 * both) & (9 * apart <= both)


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def labelled(shared: DataFrame, near: DataFrame) -> DataFrame:
    """Postings with label, their class's component by the links ``near``."""
    label = light(connected_components(near.toDF("u", "v")))
    return shared.join(label, shared.key == label.node, "left").withColumn("label", F.coalesce("component", "key")).drop("node", "component")


def with_pivots(own: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes of different labels, one a pivot of a token that both are at, that sizes and sketches allow."""
    row = F.struct("key", "size", "label")
    picks = [F.min_by(row, F.xxhash64("key", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *picks).where("lo != hi")
    each = pivots.select("token", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("y"))
    sizes = 5 * F.least("x.size", "y.size") >= 4 * F.greatest("x.size", "y.size")
    pairs = keep(pairs_of(own.select("token", row.alias("x")).join(each, "token").where((F.col("x.label") != F.col("y.label")) & sizes)), "tries")
    few = F.struct("size", "sketch", F.lit(0).alias("place"))
    both = pairs.join(classes.select(F.col("key").alias("a"), few.alias("x")), "a").join(classes.select(F.col("key").alias("b"), few.alias("y")), "b")
    return both.where(may_be_alike("x", "y")).select("a", "b")


def across(own: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """a, b: classes at one token, in different components, that may be alike."""
    by_label = own.groupBy("token", "label").agg(F.count("*").alias("n"))
    sums = by_label.groupBy("token").agg(F.sum("n").alias("n"), F.max_by("label", "n").alias("largest"), F.count("*").alias("labels")).where("labels > 1")
    dealt = own.join(sums.select("token", "largest", F.ceil(F.col("n") / block).cast("int").alias("parts")), "token")
    dealt = keep(dealt.join(classes.select("key", "sketch"), "key"), "dealt")
    row = F.struct("key", "size", "place", "sketch", "label").alias("r")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    homes = dealt.select("token", part.alias("part"), row)
    few = dealt.where("label != largest").select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), row, "largest")
    x, y = few.withColumnRenamed("r", "x"), homes.withColumnRenamed("r", "y")
    once = (F.col("y.label") == F.col("largest")) | (F.col("x.key") < F.col("y.key"))
    return pairs_of(x.join(y, ["token", "part"]).where((F.col("x.label") != F.col("y.label")) & once & may_be_alike("x", "y")))


def components(own: DataFrame, texts: DataFrame, block: int = 1024, crowd: int = 2000) -> DataFrame:
    """key and component of each class of ``own`` (the ``signatures`` of ``texts``) that is not its component's own."""
    one = [F.first(c).alias(c) for c in ("fp", "size", "sketch")]
    classes = keep(own.groupBy("key").agg(*one, F.min(F.struct("doc_id", "tag")).alias("text_of")), "classes")
    # 1: fingerprints, of the classes that have any shingles
    alone = classes.where("size > 0")
    fps = alone.groupBy("fp").agg(F.min("key").alias("rep"))
    found = keep(anchor_links(fps, crowd), "links")
    crowded = found.where("v is null").select("fp", F.col("u").alias("rep")).distinct()
    pairs = found.where("v is not null").select("u", "v").union(crowd_links(crowded))
    pairs = pairs.union(alone.join(fps, "fp").where("key != rep").select("key", "rep")).toDF("a", "b")
    near = verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, texts)
    # 2: shared first tokens; one shuffle serves both sides of the join
    listed = postings(texts, own.count()).repartition("token")
    tokens = listed.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("token")
    shared = keep(listed.join(tokens, "token", "left_semi").distinct().join(classes.select("key", "size"), "key"), "shared")
    near = near.union(verify(with_pivots(labelled(shared, near), classes), classes, texts))
    # 3: the rest
    near = near.union(verify(across(labelled(shared, near), classes, block), classes, texts))
    found = connected_components(near.toDF("u", "v")).toDF("key", "component")
    forget(classes, shared)
    return found


def representatives(docs: DataFrame, block: int = 1024, crowd: int = 2000) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the text with the smallest doc_id, once, and rows without a doc_id."""
    given = texts_of(docs)
    own = keep(signatures(given), "shingles")
    each = own.join(components(own, given, block, crowd), "key", "left").select("doc_id", "tag", F.coalesce("component", "key").alias("component"))
    each = keep(each, "components")
    winners = each.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("w"))
    texts = each.groupBy("doc_id", "tag").agg(F.first("component").alias("component"), F.count("*").alias("n"))
    texts = keep(texts.join(winners, "component").select("doc_id", "tag", "n", (F.struct("doc_id", "tag") == F.col("w")).alias("stays")), "texts")
    forget(own, each)
    tagged = docs.withColumns({"_tag": tag_of(), "_id": F.col("doc_id").cast("long")})

    def having(kind: str, where: str) -> DataFrame:
        some = light(texts.where(where).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")))
        return tagged.join(some, ["_id", "_tag"], kind)

    once = having("left_anti", "not stays or n > 1")  # rows without a doc_id among them
    again = having("left_semi", "stays and n > 1").dropDuplicates(["_id", "_tag"])
    return once.unionByName(again).select(docs.columns)
