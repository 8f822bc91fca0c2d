"""Links across files by literals, mentions and globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import literal_of
from spanloom.operators.filters import glob_pattern


def literal_sides(lines: DataFrame, file: str, text: str) -> DataFrame:
    """literal, sides (files that hold it) and single: whether it has one side."""
    own = lines.select(file, literal_of(text).alias("literal")).where("literal != ''")
    return own.groupBy("literal").agg(F.countDistinct(file).alias("sides")).withColumn("single", F.col("sides") == 1)


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", token: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """key, name, n: how often a text holds each name as a whole word; words are joined by equality, so names may be many."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({token})"), F.lit(1))).alias(name))
    return words.groupBy(key, name).agg(F.count("*").alias("n")).join(names.select(name).distinct(), name).select(key, name, "n")


def glob_matches(paths: DataFrame, path: str, globs: dict[str, list[str]]) -> DataFrame:
    """path and domain of each domain with a glob that matches; globs are few and written into the plan."""
    tests = [F.when(F.col(path).rlike("|".join(map(glob_pattern, g))), F.lit(d)) for d, g in sorted(globs.items())]
    return paths.select(path, F.explode(F.array_compact(F.array(*tests))).alias("domain"))


def missing_references(references: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    return references.join(files.select(path).distinct(), path, "left_anti")


def difference(desired: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key and state: missing, extra, different or same."""
    a, b = desired.select(key, F.col(value).alias("_d"), F.lit(1).alias("_a")), actual.select(key, F.col(value).alias("_e"), F.lit(1).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_d").eqNullSafe(F.col("_e")), "different").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def env_keys(text: Column) -> Column:
    """Names in capitals that an example of an environment file sets."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:export\s+)?([A-Z][A-Z0-9_]+)\s*="), F.lit(1))


def front_paths(text: Column) -> Column:
    """The list under ``paths:`` of a text's front matter; null without one, empty if it is empty."""
    front = F.regexp_extract(F.regexp_replace(text, "\r\n", "\n"), r"(?s)\A---\n(.*?)\n---\n", 1)
    item = r"""[ \t]+-[ \t]+["']?([^"'#\n]+?)["']?[ \t]*"""
    block = F.regexp_extract(F.concat(front, F.lit("\n")), rf"(?m)^paths:[ \t]*\n((?:{item}\n)*)", 1)
    return F.when(front.rlike(r"(?m)^paths:[ \t]*$"), F.regexp_extract_all(block, F.lit(f"(?m)^{item}$"), F.lit(1)))
