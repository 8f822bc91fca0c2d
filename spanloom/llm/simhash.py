"""SimHash near-duplicates, found by anchor points of a covering code.

Fingerprints within ``THRESHOLD`` = 2 bits link. Of two such fingerprints, one half of 32
bits differs in one bit at most. In each half the anchors are the words of the Hamming code
of length 31 (covering radius 1); a fingerprint goes to every anchor within covering radius
plus threshold 1, at most 16 in a half, so linked fingerprints meet at an anchor, where they
are compared in full.

Copies are one fingerprint before anything is dealt out. An anchor with more than
``crowd`` fingerprints is not compared in its task: its fingerprints go to a second exact
way, where each is sent to the 65 words within one bit of it. Two fingerprints within two
bits share such a word, and a minimum over each word, which Spark combines before the
shuffle, links them without comparing any pair.

Cases: a null text is the empty text; texts without words have fingerprint zero, which links
like any other. Rows without a doc_id get a fingerprint and no say in a component. Rows that
repeat a doc_id keep a row each. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import keep, small_batches, text_of
from spanloom.llm.components import connected_components

SEED, THRESHOLD, BITS = 42, 2, 64
U = np.uint64


def fingerprint(text: str, words_in_shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < words_in_shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=U)
    else:
        begins = list(accumulate(map((1).__add__, map(len, words)), initial=0))
        ends = [x - 1 for x in begins[words_in_shingle:]]
        parts = map(joined.__getitem__, map(slice, begins, ends))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=U, count=len(ends))
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        some = hashes[k : k + (1 << 15)]
        counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def hamming_masks() -> np.ndarray:
    """For each syndrome of the code of length 31 (bit i has syndrome i + 1), the words of weight 2 or less that have it.

    Adding such a word to one of that syndrome gives an anchor, within covering radius plus
    threshold. Syndrome 0 has the empty word alone, filled up by repeats of it.
    """
    masks = [[] for _ in range(32)]
    masks[0].append(0)
    for i in range(31):
        masks[i + 1].append(1 << i)
        for j in range(i):
            masks[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
    return np.array([m if len(m) == 16 else m * 16 for m in masks], dtype=U)


MASKS = hamming_masks()
CHECKS = np.array([sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)], dtype=U)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys of unsigned fingerprints, and the index of the fingerprint of each."""
    keys, of = [], []
    for half in (0, 1):
        word = (fp >> U(32 * half)) & U((1 << 31) - 1)
        syndrome = np.zeros(len(fp), dtype=np.int64)
        for k, check in enumerate(CHECKS):
            syndrome |= (np.bitwise_count(word & check).astype(np.int64) & 1) << k
        key = (word[:, None] ^ MASKS[syndrome]) | U(half << 31)
        first = np.ones(key.shape, dtype=bool)
        first[syndrome == 0, 1:] = False
        keys.append(key[first])
        of.append(np.nonzero(first)[0])
    return np.concatenate(keys), np.concatenate(of)


def compare(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys, as a spanning forest."""
    found_a, found_b, here, shift = [], [], np.arange(len(key)), 0
    while len(here):
        shift += 1
        here = here[here < len(key) - shift]
        here = here[key[here] == key[here + shift]]
        near = here[np.bitwise_count(fp[here] ^ fp[here + shift]) <= THRESHOLD]
        found_a.append(rep[near])
        found_b.append(rep[near + shift])
    from spanloom.llm.components import forest

    return forest(np.concatenate(found_a or [rep[:0]]), np.concatenate(found_b or [rep[:0]]))


def anchor_links(classes: DataFrame, crowd: int) -> DataFrame:
    """u, v: links between classes (fp, rep). v null: a class in a crowd of more than ``crowd``, with its fp."""

    def deal(batches):
        for batch in batches:
            for k in range(0, len(batch), 1 << 14):
                fp, rep = batch["fp"].to_numpy()[k : k + (1 << 14)], batch["rep"].to_numpy()[k : k + (1 << 14)]
                key, of = anchors(fp.view(U))
                yield pd.DataFrame({"anchor": key.view(np.int64), "fp": fp[of], "rep": rep[of]})

    def meet(batches):
        carry = None
        crowded = None  # the anchor whose rows are passed on

        def links(key, fp, rep):
            nonlocal crowded
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            many = np.repeat((sizes > crowd) | (key[starts] == crowded if crowded is not None else False), sizes)
            u, v = compare(key[~many], fp[~many].view(U), rep[~many])
            if many.any() and many[-1]:
                crowded = key[-1]
            out = [pd.DataFrame({"u": u, "v": pd.array(v, dtype="Int64"), "fp": pd.array([None] * len(u), dtype="Int64")})]
            if many.any():
                out.append(pd.DataFrame({"u": rep[many], "v": pd.array([None] * int(many.sum()), dtype="Int64"), "fp": pd.array(fp[many], dtype="Int64")}))
            return pd.concat(out)

        for batch in batches:
            now = [batch["anchor"].to_numpy(), batch["fp"].to_numpy(), batch["rep"].to_numpy()]
            if carry is not None:
                now = [np.concatenate(x) for x in zip(carry, now)]
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))
            if len(now[0]) - last > crowd or now[0][-1] == crowded:
                last = len(now[0])
            carry = [x[last:] for x in now]
            if last:
                yield links(*(x[:last] for x in now))
        if carry is not None and len(carry[0]):
            yield links(*carry)

    dealt = classes.mapInPandas(deal, "anchor long, fp long, rep long")
    return dealt.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(meet, "u long, v long, fp long")


def crowd_links(crowded: DataFrame) -> DataFrame:
    """u, v: links between classes (fp, rep) that share a word within one bit of both."""

    def spread(batches):
        flips = np.concatenate([[U(0)], U(1) << np.arange(64, dtype=U)])
        for batch in batches:
            for k in range(0, len(batch), 1 << 13):
                fp, rep = batch["fp"].to_numpy()[k : k + (1 << 13)].view(U), batch["rep"].to_numpy()[k : k + (1 << 13)]
                yield pd.DataFrame({"word": (fp[:, None] ^ flips).ravel().view(np.int64), "rep": np.repeat(rep, 65)})

    words = crowded.mapInPandas(spread, "word long, rep long")
    least = words.groupBy("word").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).where("v != most").select("word", "v")
    return words.join(least, "word").where("rep != v").select(F.col("rep").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, crowd: int = 2000) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable by links."""
    own = keep(fingerprints(docs), "fingerprints")
    classes = own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = keep(anchor_links(classes, crowd), "links")
    crowded = links.where("v is null").select("fp", F.col("u").alias("rep")).distinct()
    edges = links.where("v is not null").select("u", "v").union(crowd_links(crowded))
    component = connected_components(edges)
    labelled = classes.join(component, classes.rep == component.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(labelled, "fp", "left").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
