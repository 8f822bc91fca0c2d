"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded in Arrow batches, and written by
Spark's ORC writer, one file for each range. Stripes are read in parallel, and a lookup by
document id prunes files and stripes by their statistics, row groups by the row index and
the Bloom filter.

Cases: a null text is the empty text, whose only id is the end id. Rows without a doc_id
take no part. Rows that repeat a doc_id are all written, beside each other, in order of a hash
of their texts. Each row carries its place in its file. Columns other than doc_id and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import list_array, list_bytes, small_batches, text_of
from spanloom.llm.subwords import byte_bpe

SCHEMA = "part int, before long, doc_id long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """before (ids of the rows before in its partition), doc_id, n_tokens and ids (the end id last) in ascending doc_id order over the partitions."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        bpe, done = byte_bpe(tokenizer), 0
        for batch in small_batches(batches):
            ids = [x + end for x in bpe.encode(batch.column("text"))]
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            before = done + np.cumsum(counts) - counts
            done += int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(before), batch.column("doc_id"), pa.array(counts), list_array(ids)], ["before", "doc_id", "n_tokens", "ids"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, "before long, doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, row_group: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Writes the ids of ``docs`` under ``path``. ``part`` numbers the files in doc_id order."""
    (
        encode_documents(docs, tokenizer, end_id)
        .select(F.spark_partition_id().alias("part"), "before", "doc_id", "n_tokens", "ids")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(max(1000, row_group)))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, before, doc_id, n_tokens and ids; filters on doc_id and part reach the ORC reader."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents: files, stripes and row groups without them are not read."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def digests(tokens: DataFrame) -> DataFrame:
    """part, before, doc_id, n_tokens and ids_crc32, from the ids as they are read."""

    def crc(batches):
        for batch in batches:
            ids = list_bytes(batch.column("ids"))
            found = [
                batch.column("part"),
                batch.column("before"),
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(found, ["part", "before", "doc_id", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "part int, before long, doc_id long, n_tokens long, ids_crc32 long")


def positions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before in the files, to digests. Of ``files`` only part and n_tokens are read: sums by file give each file's offset, so only those meet in one task."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
