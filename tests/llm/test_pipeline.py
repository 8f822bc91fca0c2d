import pytest

import __spark_entry__
import corpus_pipeline
from conftest import HARD_TEXTS, SF
from spanloom.llm import prefix_free
from test_near_copies import brute as brute_copies
from test_prefix_free import brute as brute_repeats
from test_tokens_and_packing import check_pieces, library  # noqa: F401


def test_pipeline_by_stages(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == columns and 0 < clean.count() < docs.count()
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    single = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == brute_copies(texts)[0]
    texts = [(r.doc_id, r.text) for r in single.collect()]
    cut = corpus_pipeline.cut_repeats(spark, single, SF).cache()
    assert cut.columns == columns
    want = {d: n - removed for d, n, removed, _, _ in brute_repeats(texts)}
    got = {r.doc_id: r for r in cut.collect()}
    assert got.keys() == want.keys() and all(want[d] - 6 <= len(r.text.encode()) <= want[d] and r.n_chars == len(r.text) for d, r in got.items() if r.text != dict(texts)[d])
    pieces = corpus_pipeline.pack_windows(spark, cut, SF).collect()
    check_pieces(pieces, [(d, r.text) for d, r in got.items()], library)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in __spark_entry__.queries()["pipeline"](spark, SF).collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in pieces}


@pytest.mark.parametrize("empty", [False, True])
def test_hard_and_empty(spark, hard_docs, no_docs, empty):
    docs = (no_docs if empty else hard_docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars", "1 as parts", "2 as component_id", "3 as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == (0 if empty else {"toxicity": 10, "simhash": 5 + 1, "suffix_array": 10}.get(name)), name
    assert (corpus_pipeline.pack_windows(spark, docs, SF).count() == 0) == empty


def test_cut_keeps_null_and_splits_no_character(spark):
    rows = [(1, "é" * 120, 120), (2, "a" + "é" * 130, 131), (3, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in prefix_free.cut(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[1] == ("é", 1) and got[2] == ("a", 1) and got[3] == (None, None)
