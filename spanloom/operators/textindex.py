"""A stored positional index for full-text search.

``build`` writes blocks of postings under a folder for each bucket (crc32 of the term): a row is a term
with those texts of a block of texts that hold it, and its places in them, laid end to end. A task
makes the blocks of its own texts, so words meet in memory and only blocks are shuffled. The lengths of the live texts stand in a small table beside it.
A search reads the folders of its terms only. Words of a phrase meet by equality of text;
their places, shifted by their number, are intersected. ``replace`` and ``forget`` never rewrite postings: new texts get
a generation of their own, and the new table of lengths says which generation of a text is live;
postings of others find no partner in the join that brings the lengths. Numbers of texts and mean
length come from that table, so they are exact at once. ``compact`` writes the live postings anew.
A handle names one state of the index and stays valid while later ones are made.

A bucket's rows are dealt out by block, so a word that stands in every text fills ``parts`` files
of its bucket and no single task. Each key is one text; tables that repeat one are refused. Null
texts are not indexed, and replacing a text by null forgets it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import search_tokens
from spanloom.operators.search import CANDIDATES, bm25_score, ranked

#: Words of a block of texts, about: what a task holds at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class TextIndex:
    """One state of an index in a folder; ``texts`` is its table of live texts."""

    path: str
    key: str
    generations: tuple[str, ...]
    texts: str
    buckets: int
    parts: int

    def bucket_of(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets


def _new() -> str:
    return uuid.uuid4().hex


def live(spark: SparkSession, index: TextIndex) -> DataFrame:
    """key, generation, length and what was carried along of each live text."""
    return spark.read.parquet(f"{index.path}/texts/{index.texts}")


def postings_of(spark: SparkSession, index: TextIndex, terms: Sequence[str] | None = None) -> DataFrame:
    """key, generation, term and places, in all generations; of some terms from their buckets alone."""
    kind = live(spark, index).schema[index.key].dataType.simpleString()
    schema = f"term string, hits array<struct<of:{kind},places:array<int>>>, generation string, bucket int"  # an empty index has no file to infer it from
    rows = spark.read.schema(schema).option("basePath", f"{index.path}/postings").parquet(*(f"{index.path}/postings/generation={g}" for g in index.generations))
    if terms is not None:
        rows = rows.where(F.col("bucket").isin(sorted({index.bucket_of(t) for t in terms})) & F.col("term").isin(sorted(set(terms))))
    return rows.select("generation", "term", F.inline("hits")).select(F.col("of").alias(index.key), "generation", "term", "places")


def _blocks(tokens: DataFrame, key: str) -> DataFrame:
    """term and hits of blocks of texts, from their words in order (``_tokens``)."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            words = np.asarray(pc.list_value_length(batch.column(1)))
            block = (np.cumsum(words) - words) // BLOCK
            for first in np.flatnonzero(np.diff(block, prepend=-1)):
                part = batch.slice(first, int(np.count_nonzero(block == block[first])))
                size = np.asarray(pc.list_value_length(part.column(1)))
                coded = part.column(1).flatten().dictionary_encode()
                order = np.argsort(coded.indices.to_numpy(), kind="stable")  # by term, then as they stand
                of = np.repeat(np.arange(len(size)), size)[order]
                place = (np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size))[order]
                code = coded.indices.to_numpy()[order]
                hit = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
                term = np.flatnonzero(np.diff(code[hit], prepend=-1) != 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(hit, len(order)), pa.int32()), pa.array(place, pa.int32()))
                hits = pa.StructArray.from_arrays([part.column(0).take(pa.array(of[hit])), lists], ["of", "places"])
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[hit][term])), pa.ListArray.from_arrays(pa.array(np.append(term, len(hit)), pa.int32()), hits)], ["term", "hits"])

    return tokens.select(key, "_tokens").mapInArrow(run, f"term string, hits array<struct<of:{kind},places:array<int>>>")


def _write_postings(rows: DataFrame, index: TextIndex, generation: str) -> None:
    """``rows``: term and hits (of, places)."""
    own = rows.withColumns({"bucket": (F.crc32(F.col("term").cast("binary")) % index.buckets).cast("int"), "_part": F.pmod(F.xxhash64(F.get("hits", F.lit(0))["of"]), F.lit(index.parts))})
    dealt = own.repartition("bucket", "_part").sortWithinPartitions("bucket", "term").drop("_part")
    dealt.write.partitionBy("bucket").parquet(f"{index.path}/postings/generation={generation}")


def _write_texts(rows: DataFrame, index: TextIndex, generations: tuple[str, ...]) -> TextIndex:
    name = _new()
    rows.write.parquet(f"{index.path}/texts/{name}")
    made = TextIndex(index.path, index.key, generations, name, index.buckets, index.parts)
    seen = live(rows.sparkSession, made).agg(F.count("*").alias("n"), F.countDistinct(index.key).alias("d")).first()
    if seen.n != seen.d:
        raise ValueError(f"{seen.n} texts, {seen.d} values of {index.key}")
    return made


def _add(docs: DataFrame, index: TextIndex, generation: str, text: str, carry: Sequence[str]) -> DataFrame:
    """Writes the postings of ``docs``; gives their rows of the table of texts."""
    own = docs.where(F.col(text).isNotNull() & F.col(index.key).isNotNull()).select(index.key, *carry, F.explode(F.array(search_tokens(text))).alias("_tokens"))
    _write_postings(_blocks(own, index.key), index, generation)
    return own.select(index.key, F.lit(generation).alias("generation"), F.size("_tokens").alias("length"), *carry)


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), buckets: int = 64, parts: int = 4) -> TextIndex:
    """An index of ``docs`` in the folder ``path``; ``carry`` names columns that filters need."""
    index, generation = TextIndex(path, key, (), "", buckets, parts), _new()
    return _write_texts(_add(docs, index, generation, text, carry), index, (generation,))


def replace(index: TextIndex, docs: DataFrame, text: str = "text") -> TextIndex:
    """The index with the texts of ``docs`` in place of those of the same key."""
    spark, generation = docs.sparkSession, _new()
    old = live(spark, index)
    carry = [c for c in old.columns if c not in (index.key, "generation", "length")]
    new = _add(docs, index, generation, text, carry)
    stay = old.join(docs.select(index.key).distinct(), index.key, "left_anti")
    return _write_texts(stay.unionByName(new), index, (*index.generations, generation))


def forget(index: TextIndex, keys: DataFrame) -> TextIndex:
    """The index without the texts of ``keys``."""
    stay = live(keys.sparkSession, index).join(keys.select(index.key).distinct(), index.key, "left_anti")
    return _write_texts(stay, index, index.generations)


def compact(spark: SparkSession, index: TextIndex) -> TextIndex:
    """The same index with one generation."""
    generation, texts = _new(), live(spark, index)
    kept = postings_of(spark, index).join(texts.select(index.key, "generation"), [index.key, "generation"], "left_semi")
    some = F.pmod(F.xxhash64(index.key), F.lit(1 + texts.count() // (1 << 16)))
    blocks = kept.groupBy("term", some.alias("_some")).agg(F.collect_list(F.struct(F.col(index.key).alias("of"), "places")).alias("hits"))
    _write_postings(blocks.drop("_some"), index, generation)
    return _write_texts(texts.withColumn("generation", F.lit(generation)), index, (generation,))


def phrase_hits(spark: SparkSession, index: TextIndex, phrase: Sequence[str]) -> DataFrame:
    """key, generation and tf: how often the words of ``phrase`` stand beside each other, in all generations."""
    if len(phrase) == 1:
        return postings_of(spark, index, phrase).select(index.key, "generation", F.size("places").alias("tf"))
    words = (postings_of(spark, index, [w]).select(index.key, "generation", F.expr(f"transform(places, x -> x - {i})").alias(f"_begin{i}")) for i, w in enumerate(phrase))
    met = reduce(lambda a, b: a.join(b, [index.key, "generation"]), words)
    begins = reduce(F.array_intersect, (f"_begin{i}" for i in range(len(phrase))))
    return met.select(index.key, "generation", F.size(begins).alias("tf")).where("tf > 0")


def bm25(spark: SparkSession, index: TextIndex, phrases: Sequence[Sequence[str]], k: int = CANDIDATES, where: Column | None = None) -> DataFrame:
    """key, score and rank, as ``search.bm25`` gives them over the live texts; ``where`` is on columns that were carried along."""
    if not phrases:
        return live(spark, index).select(index.key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    of = [f"f{distinct.index(tuple(p))}" for p in phrases]
    names = list(dict.fromkeys(of))
    hits = reduce(DataFrame.unionByName, (phrase_hits(spark, index, p).withColumn("_which", F.lit(n)) for n, p in zip(names, distinct)))
    wide = hits.groupBy(index.key, "generation").agg(*(F.coalesce(F.max(F.when(F.col("_which") == n, F.col("tf"))), F.lit(0)).alias(n) for n in names))
    texts = live(spark, index)
    counted = wide.join(texts, [index.key, "generation"]).withColumnRenamed("length", "_length")
    found = counted.agg(*(F.coalesce(F.sum(F.when(F.col(n) > 0, 1).otherwise(0)), F.lit(0)).alias(f"_{n}") for n in names))
    stats = texts.agg(F.count("*").alias("_n"), F.avg("length").alias("_mean")).crossJoin(found)  # one row each
    own = counted if where is None else counted.where(where)
    return ranked(own.crossJoin(F.broadcast(stats)).select(index.key, bm25_score(of).alias("score")), [F.col("score").desc(), F.col(index.key)], k)
