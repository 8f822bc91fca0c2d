"""Hybrid retrieval: vector and full-text rankings, filtered inside, fused by reciprocal ranks.

A query is bounded: one vector, some terms. Both rankings are one scan each with a top-k at
its end; nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import search_tokens

FUSION, CANDIDATES, TOP = 60, 40, 8
K1, B = 1.2, 0.75


def distance(column: str, vector: Sequence[float]) -> Column:
    """Euclidean distance in double precision."""
    query = F.array(*(F.lit(float(v)) for v in vector))
    return F.sqrt(F.aggregate(F.zip_with(column, query, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def ranked(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows with their rank; only k rows meet in one task."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def knn(df: DataFrame, vector: Sequence[float], k: int = CANDIDATES, key: str = "vec_id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """key, distance and rank of the k nearest rows; ``where`` acts before the cut."""
    own = df if where is None else df.where(where)
    scored = own.select(key, distance(column, vector).alias("distance"))
    return ranked(scored, [F.col("distance"), F.col(key)], k)


def phrase_count(tokens: Column, phrase: Sequence[str]) -> Column:
    """How often the words stand beside each other."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))

    def here(t, i):
        return reduce(lambda a, b: a & b, (F.get(tokens, i + k) == w for k, w in enumerate(phrase)))

    return F.size(F.filter(tokens, lambda t, i: F.coalesce(here(t, i), F.lit(False))))


def bm25_score(names: Sequence[str]) -> Column:
    """The sum over phrases, from their counts (``f0``), the texts that hold them (``_f0``), ``_length``, ``_mean`` and ``_n``."""

    def part(n):
        raw = F.ln((F.col("_n") - F.col(f"_{n}") + 0.5) / (F.col(f"_{n}") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(1e-6)
        return idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))

    return reduce(lambda a, b: a + b, map(part, names), F.lit(0.0))


def bm25(df: DataFrame, phrases: Sequence[Sequence[str]], k: int = CANDIDATES, key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """key, score and rank. Each phrase is folded words that must stand together; a repeated one counts again.

    Numbers of documents, of those with a phrase and the mean length are of the whole table;
    ``where`` only restricts the rows that are ranked. No phrases give no rows. The tokens come
    out of a generator of one row, which the optimiser neither repeats nor pushes filters
    through, so each of the two passes over the table cuts a text once.
    """
    names = [f"f{i}" for i in range(len(phrases))]
    tokens = df.where(F.col(text).isNotNull()).select("*", F.explode(F.array(search_tokens(text))).alias("_tokens"))
    counted = tokens.withColumns({n: phrase_count(F.col("_tokens"), p) for n, p in zip(names, phrases)} | {"_length": F.size("_tokens")})
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *(F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).alias(f"_{n}") for n in names))
    hit = reduce(lambda a, b: a | b, (F.col(n) > 0 for n in names), F.lit(False))
    own = counted if where is None else counted.where(where)
    joined = own.where(hit).crossJoin(F.broadcast(stats))  # one row of totals

    return ranked(joined.select(key, bm25_score(names).alias("score")), [F.col("score").desc(), F.col(key)], k)


def fuse(vectors: DataFrame, texts: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """key, score, rank: sums of 1 / (60 + rank); ties keep the vector ranking's order, then the other's."""
    both = vectors.select(key, F.col("rank").alias("v"), F.lit(None).cast("int").alias("t")).unionByName(texts.select(key, F.lit(None).cast("int").alias("v"), F.col("rank").alias("t")))
    one = both.groupBy(key).agg(F.max("v").alias("v"), F.max("t").alias("t"))
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    scored = one.withColumn("score", part("v") + part("t")).withColumn("tie", F.coalesce("v", F.lit(1_000_000) + F.col("t")))
    return ranked(scored, [F.col("score").desc(), F.col("tie")], top).select(key, "score", "rank")


def hybrid(vectors: DataFrame, texts: DataFrame, vector: Sequence[float], phrases, key: str, where: Column | None = None, top: int = TOP, candidates: int = CANDIDATES) -> DataFrame:
    """Both rankings over tables with ``key``, embedding and text, fused."""
    return fuse(knn(vectors, vector, candidates, key, where=where), bm25(texts, phrases, candidates, key, where=where), key, top)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf and length of the document."""
    tokens = docs.where(F.col(text).isNotNull()).select(key, search_tokens(text).alias("tokens"))
    return tokens.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def nearest_of_each(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", most: int = 4096) -> DataFrame:
    """query_id, key, distance, rank for each of at most ``most`` queries, broadcast in blocks, against all rows."""
    held = queries.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} queries")
    out = None
    for row in held:
        one = knn(rows, row[column], k, key, column).select(F.lit(row[key]).alias("query_id"), key, "distance", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def compatible(table: dict[str, str], model: str, engine: str | None) -> str | None:
    """Why an index cannot serve a model, or None; an index without an engine stamp serves any."""
    if table.get("model") != model:
        return f"index made by {table.get('model')}, not {model}"
    if engine is not None and table.get("engine") not in (None, engine):
        return f"index made by engine {table['engine']}, not {engine}"
    return None
