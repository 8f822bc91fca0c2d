"""The tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned ts and target, the number in their properties."""
    own = table(spark, sf_dir, "events")
    return own.withColumns({"ts": F.col("ts").cast("timestamp"), "target": F.get_json_object("props", "$.k").cast("int")})
