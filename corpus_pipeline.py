"""A cleaning pipeline over ``documents``: toxicity, near copies, repeated passages, packing.

Every stage takes all rows that the one before it kept and returns the columns of documents,
but the last, which returns packed pieces. ``run`` writes each stage's rows as Parquet to the
shared folder and reads them again for the next.

Cases, in every stage: a null text counts as the empty text and stays null where it is kept.
Rows without a doc_id pass the first three stages and are not packed. Rows that share a doc_id
are judged by their texts: copies go, unlike texts stay beside each other. An empty table gives
an empty table. Other columns are carried along by the first three stages.

The stages set the session to Arrow batches of 1,000 rows, since most rows hold a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import near_copies, packing, prefix_free, toxicity
from spanloom.llm.common import keep, slim
from spanloom.llm.queries import BYTE_BPE, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The labels are learned from the documents at hand."""
    slim(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), most=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash with anchor points, completed exactly: of each group of documents linked by a similarity of 0.8 over five-word shingles the one with the smallest doc_id stays; rows without a doc_id stay."""
    slim(spark)
    return near_copies.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 100 bytes that also start earlier go from the texts."""
    slim(spark)
    return prefix_free.cut(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids, with their ids."""
    slim(spark)
    return packing.pack(docs, BYTE_BPE, end_id=1, window=2048, lean=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_array", cut_repeats), ("packing", pack_windows)]

#: SQL can express neither a trained model nor the dynamic program; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
