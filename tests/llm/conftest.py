import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties and repeated rows.
HARD_TEXTS = [
    (1, "Plain words here. And more!\nA second line"),
    (2, None),
    (3, ""),
    (4, "   \t\n "),
    (5, "x" * 70_000),
    (6, "日本語 のテキスト ² ½ <|endoftext|> don't we'll"),
    (7, "Plain words here. And more!\nA second line"),
    (7, "Plain words here. And more!\nA second line"),
    (8, "word " * 5000),
    (None, "no id"),
]


@pytest.fixture(scope="session")
def hard_docs(spark):
    return spark.createDataFrame([(a, b, "en", None, 1) for a, b in HARD_TEXTS], "doc_id long, text string, lang string, source string, start int")


@pytest.fixture(scope="session")
def no_docs(spark, hard_docs):
    return hard_docs.where("false")
