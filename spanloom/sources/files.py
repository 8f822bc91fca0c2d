"""Text files as rows with a status, error logs, settings, and result sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import trim_text
from spanloom.operators.filters import in_skipped_folder, is_text_by_content, is_text_by_name
from spanloom.operators.index import snapshot_diff


def below(path: Column, root: str) -> Column:
    """The part of a file's path below ``root``."""
    plain = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.substring(path, F.locate(plain, path) + len(plain), F.length(path))


def listing(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """path (below ``root``), size, mtime and file (the whole path); no file is opened.

    ``listed``: rows with a path, as version control lists them; only these count then. Files and
    folders whose names begin with a dot or an underscore are left out, as Spark lists none.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    every = read.select(below(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.col("path").alias("file"))
    return every if listed is None else every.join(listed.select("path").distinct(), "path", "left_semi")


def candidates(files: DataFrame) -> DataFrame:
    return files.where(is_text_by_name(F.col("path")) & ~in_skipped_folder(F.col("path")))


def due(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Files that ``known`` does not have with the same size and mtime."""
    return files if known is None else files.join(known.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def contents(spark: SparkSession, files: DataFrame, root: str, most: int = 1_000_000) -> DataFrame:
    """path, size, mtime, hash, binary (a zero byte at its beginning, or more than ``most`` bytes), blank and text of ``files``, rows of a listing; no other file is opened.

    The driver, which holds the list of all files of a folder when Spark reads one, holds the
    names of these. Files that are gone by now are left out; bytes that are no UTF-8 are read as Latin-1.
    """
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.file) for r in files.select("file").distinct().collect()]
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(names) if names else spark.createDataFrame([], schema)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    lossy = F.coalesce(text, F.decode("content", "ISO-8859-1"))
    return read.select(
        below(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"),
        (~is_text_by_content(F.col("content"), most)).alias("binary"), (~lossy.rlike(r"\S")).alias("blank"), lossy.alias("text"),
    )


def scan(spark: SparkSession, root: str, known: DataFrame | None = None, most: int = 1_000_000, listed: DataFrame | None = None) -> DataFrame:
    """The contents of text files by name, at most ``most`` bytes, that ``known`` (path, size, mtime) does not have as they are."""
    return contents(spark, due(candidates(listing(spark, root, listed)).where(F.col("size") <= most), known), root, most)


def sync(spark: SparkSession, root: str, known: DataFrame, most: int = 1_000_000, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The status of each file of either side, against ``known`` (path, size, mtime, hash), and the contents that were read for it."""
    files = candidates(listing(spark, root, listed)).where(F.col("size") <= most)
    read = contents(spark, due(files, known), root, most)
    now = files.select("path", "size", "mtime").join(read.select("path", "hash", "binary", "blank"), "path", "left")
    same = known.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"))
    current = now.join(same, "path", "left").withColumn("_same", F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), F.lit(False)))
    current = current.select("path", "size", "mtime", F.when(F.col("_same"), F.col("_hash")).otherwise(F.col("hash")).alias("hash"), (F.col("_same") | F.col("hash").isNotNull()).alias("readable"), F.coalesce("binary", F.lit(False)).alias("binary"), F.coalesce("blank", F.lit(False)).alias("blank"))
    return snapshot_diff(current, known), read


def error_entries(spark: SparkSession, path: str, keep: int = 25, width: int = 200) -> DataFrame:
    """Entries of an error log: header and the last ``keep`` lines, without colours, blank lines and repeats in a row."""
    raw = spark.read.option("lineSep", "---\n").text(path).where(F.trim("value") != "")
    lines = F.transform(F.split(F.regexp_replace("value", "\x1b\\[[0-9;]*[A-Za-z]", ""), "\n"), lambda x: F.substring(F.rtrim(x), 1, width))
    full = F.filter(lines, lambda x: F.trim(x) != "")
    once = F.filter(full, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(full, i - 1)))
    rest = F.slice(once, 2, F.greatest(F.size(once) - 1, F.lit(0)))
    tail = F.slice(rest, F.greatest(F.size(rest) - keep + 1, F.lit(1)), F.lit(keep))
    return raw.select(F.get(once, F.lit(0)).alias("header"), tail.alias("tail"))


def uniq(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) == 1
    return df.withColumn("_new", first | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")


def decision_rows(events: DataFrame) -> DataFrame:
    """Log rows of decisions: reason cut to 160 and target to 200 characters, both redacted."""
    return events.where("decision is not null").withColumns({"reason": trim_text("reason", 160), "target": trim_text("target", 200)})


def flat_settings(df: DataFrame, column: str = "json") -> DataFrame:
    """path and value (JSON) of the first two levels of settings texts; members of arrays are values of their own."""
    top = df.select(F.expr(f"variant_explode(try_parse_json({column}))").alias("_p", "section", "value"))
    kind = F.schema_of_variant("value")
    inner = top.where(kind.like("OBJECT%")).select("section", F.expr("variant_explode(value)").alias("_p", "name", "value"))
    every = inner.select(F.concat_ws(".", "section", "name").alias("path"), "value").unionByName(top.where(~kind.like("OBJECT%")).select(F.col("section").alias("path"), "value"))
    arrays = every.where(F.schema_of_variant("value").like("ARRAY%")).select("path", F.expr("variant_explode(value)").alias("_p", "_k", "value"))
    scalars = every.where(~F.schema_of_variant("value").like("ARRAY%"))
    return arrays.select("path", F.to_json("value").alias("value")).unionByName(scalars.select("path", F.to_json("value").alias("value")))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, places: int = 5) -> None:
    """Doubles are rounded."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    df.withColumns({c: F.round(c, places) for c in doubles}).write.json(path)
