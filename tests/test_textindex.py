"""The stored index against the search that reads all texts, and what it opens."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from spanloom.operators import search, textindex
from spanloom.shared import shared_path

TEXTS = [
    (1, "en", "The quick brown fox. The quick dog, the the end"), (2, "en", "quick the brown"), (3, "de", None), (4, "de", ""), (5, "fr", "Été à la brown fox the"),
    (6, "en", "the " * 400), (7, "fr", "nothing of the kind; fox"), (8, None, "brown fox brown fox brown fox"),
]
QUERIES = [[["the"]], [["brown", "fox"]], [["the", "the"], ["quick"]], [["the", "quick", "brown"], ["fox"], ["fox"]], [["ete"], ["absent"]], [["absent"]], []]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")


@pytest.fixture
def made(spark, docs):
    return textindex.build(docs, shared_path(spark, "index"), carry=["lang"], buckets=8, parts=2)


def same(a, b):
    a, b = [tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]
    assert [(x[0], x[2]) for x in a] == [(x[0], x[2]) for x in b]
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-12)


@pytest.mark.parametrize("phrases", QUERIES)
def test_equals_the_scan(spark, docs, made, phrases):
    same(textindex.bm25(spark, made, phrases), search.bm25(docs, phrases))
    same(textindex.bm25(spark, made, phrases, where=F.col("lang") == "en"), search.bm25(docs, phrases, where=F.col("lang") == "en"))


def test_replaced_and_forgotten_texts(spark, docs, made):
    new = spark.createDataFrame([(1, "en", "a brown fox"), (9, "fr", "the brown fox and the fox"), (6, "en", None)], "doc_id long, lang string, text string")
    later = textindex.forget(textindex.replace(made, new), spark.createDataFrame([(8,), (77,)], "doc_id long"))
    now = docs.where("doc_id not in (1, 6, 8)").unionByName(new)
    for phrases in QUERIES:
        same(textindex.bm25(spark, later, phrases), search.bm25(now, phrases))
        same(textindex.bm25(spark, textindex.compact(spark, later), phrases), search.bm25(now, phrases))
        same(textindex.bm25(spark, made, phrases), search.bm25(docs, phrases))  # the former state stays


def test_reads_only_the_buckets_of_its_terms(spark, docs, made):
    folder = made.path.removeprefix("file:").replace("//", "/") + f"/postings/generation={made.generations[0]}"
    needed = {f"bucket={made.bucket_of(t)}" for t in ("brown", "fox")}
    others = [f for f in os.listdir(folder) if f.startswith("bucket=") and f not in needed]
    assert others
    wanted = search.bm25(docs, [["brown", "fox"]])
    for name in others:  # unreadable files: whoever opened one would fail
        for file in os.listdir(f"{folder}/{name}"):
            if not file.startswith("."):
                shutil.copy(__file__, f"{folder}/{name}/{file}")
                crc = f"{folder}/{name}/.{file}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    same(textindex.bm25(spark, made, [["brown", "fox"]]), wanted)
    plan = textindex.postings_of(spark, made, ["fox"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_repeated_keys_are_refused(spark, docs):
    with pytest.raises(ValueError, match="doc_id"):
        textindex.build(docs.unionByName(docs), shared_path(spark, "index"))


def test_empty_table(spark, docs):
    made = textindex.build(docs.where("false"), shared_path(spark, "index"))
    assert textindex.live(spark, made).count() == 0


def test_a_block_shuffles_once(spark):
    """Postings are rows of terms and blocks of texts, however many texts and words there are."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the end of the"), F.col("id") % 7, F.lit("end of")).alias("text")).coalesce(2)
    made = textindex.build(docs, shared_path(spark, "index"), buckets=4, parts=1)
    rows = spark.read.parquet(f"{made.path}/postings").where("term in ('the', 'end', 'of')")
    assert rows.count() <= 3 * docs.rdd.getNumPartitions() * 2
    assert rows.selectExpr("sum(size(hits))").first()[0] == 6000
    same(textindex.bm25(spark, made, [["end", "of"], ["3"]]), search.bm25(docs, [["end", "of"], ["3"]]))
