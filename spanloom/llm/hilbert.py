"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are lifted to equal norm (one more coordinate), which turns the largest inner product
into the least angle. Each of several curves projects them on other random axes, shifts them
and numbers them along a Hilbert curve. Spark range-partitions and sorts (curve, key), which
gives every vector a rank on each curve. A query's candidates are the blocks of rows its
window of ranks reaches into on any curve; they are reranked by the exact inner product in
double precision, and the nearest over all curves are merged.

The half-width of the window is fitted: a bounded sample of queries is searched by brute force
against all rows, and the width is the quantile of rank distances that brings ``recall`` of
their true neighbours into a window on at least one curve. It is small where vectors lie in
clusters and wide where they are spread evenly in many dimensions, as no curve can help there.

Queries travel to the blocks, and a block has a bounded number of rows. Copies of a vector are
one unit on the curves, with the k + 1 smallest of its distinct ids: those with larger ids
cannot be among the k nearest of any query. Found units are expanded to these ids, and every
query takes the list of its own unit, in which its copies stand.

Cases: rows without an id and vectors that are null, empty, zero or hold null or non-finite
components take no part. Vectors of unequal length compare as if filled up with zeros. Ties go
to the smaller id. Rows that repeat an id are one candidate, with their best score. Fewer
rows than k give what there is. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import keep
from spanloom.llm.vectors import content, matrix, raw_type, usable_rows, width_of

SEED = 77
NEAREST = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows x dims, each below 2**bits), dims * bits at most 63.

    The coordinates are turned, level by level, into the frame of the sub-cube they are in,
    then Gray-coded and their bits interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for c in x:
            inside = (c & level) != 0
            swap = np.where(inside, 0, (x[0] ^ c) & low)
            flip = np.where(inside, low, 0)
            if c is x[0]:
                x[0] = x[0] ^ flip
                continue
            at = next(k for k, y in enumerate(x) if y is c)
            x[0], x[at] = x[0] ^ flip ^ swap, c ^ swap
        level >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> bit & 1)
    return key


@functools.lru_cache(maxsize=4)
def frames(width: int, curves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """For each curve, orthonormal axes (width x dims) and a shift."""
    rng = np.random.default_rng(SEED)
    dims = min(dims, width)
    axes = np.stack([np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)])
    return axes, rng.uniform(0, 1, size=(curves, dims))


def curve_keys(x: np.ndarray, radius: float, curves: int, dims: int, bits: int) -> np.ndarray:
    """Keys on each curve (curves x rows) of vectors of norm ``radius`` at most, after the lift."""
    lift = np.sqrt(np.maximum(0, radius**2 - (x * x).sum(1)))
    full = np.concatenate([x, lift[:, None]], axis=1) / radius
    axes, shift = frames(full.shape[1], curves, dims)
    spread = math.sqrt(full.shape[1])
    keys = []
    for a, s in zip(axes, shift):
        uniform = 1 / (1 + np.exp(-1.702 * spread * (full @ a)))  # about the normal distribution function
        cells = ((uniform + s) / 2 * (1 << bits)).astype(np.int64)
        keys.append(hilbert_keys(np.minimum(cells, (1 << bits) - 1), bits))
    return np.array(keys)


def nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, id and score of each query's k best rows, itself left out; ties to smaller ids."""
    at, found, scores = [], [], []
    for b in range(0, len(q), 512):
        s = q[b : b + 512] @ x.T
        s[own[b : b + 512, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
            some = s >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]
        else:
            some = np.ones(s.shape, dtype=bool)
        r, c = np.nonzero(some & (s > -np.inf))
        exact = (q[b + r] * x[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        first = rank < k
        at.append(b + r[first])
        found.append(ids[c[first]])
        scores.append(exact[first])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(at or [none]), np.concatenate(found or [none]), np.concatenate(scores or [none.astype(float)])


def merge(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows, each vector once."""
    once = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(queries: pd.DataFrame, rows: DataFrame, width: int, k: int) -> DataFrame:
    """The k nearest of a bounded set of queries (vec_id, embedding on the driver) among all rows, by partition and merged."""
    own, q = queries["vec_id"].to_numpy(), matrix(queries["embedding"], width)

    def run(batches):
        for batch in batches:
            at, ids, scores = nearest(q, batch["vec_id"].to_numpy(), matrix(batch["embedding"], width), own, k)
            yield pd.DataFrame({"query_id": own[at], "vec_id": ids, "score": scores})

    return merge(rows.select("vec_id", "embedding").mapInPandas(run, NEAREST), k)


def ranked(candidates: DataFrame, width: int, curves: int, dims: int, bits: int) -> DataFrame:
    """curve, rank, vec_id, asks and vector of each candidate on each curve; ranks run on over the curves."""
    spark = candidates.sparkSession
    kind = raw_type(candidates)
    radius = candidates.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))).first()[0]
    radius = math.sqrt(radius or 1.0) * (1 + 1e-9)

    def number(batches):
        for batch in batches:
            for b in range(0, len(batch), 4096):
                some = batch.iloc[b : b + 4096]
                x = matrix(some["embedding"], width)
                vector = [v.tobytes() for v in x.astype(kind)]
                for c, key in enumerate(curve_keys(x, radius, curves, dims, bits)):
                    yield pd.DataFrame({"curve": c, "key": key, "vec_id": some["vec_id"].to_numpy(), "asks": some["asks"].to_numpy(), "vector": vector})

    schema = "curve int, key long, vec_id long, asks boolean, vector binary"
    rows = candidates.select("vec_id", "asks", "embedding").mapInPandas(number, schema)
    order = ["curve", "key", "vec_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = keep(rows.withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)}), "curves")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return rows.join(parts, "part").select("curve", (F.col("offset") + F.col("at")).alias("rank"), "vec_id", "asks", "vector")


def fit_window(rows: DataFrame, candidates: DataFrame, width: int, k: int, recall: float, sample: int, least: int) -> int:
    """The half-width of rank windows that holds ``recall`` of the true neighbours of a sample of queries."""
    some = candidates.where("asks").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "embedding").toPandas()
    if some.empty:
        return least
    truth = brute_force(some, candidates, width, k).select("query_id", "vec_id").toPandas()
    if truth.empty:
        return least
    ids = [int(i) for i in set(truth["query_id"]) | set(truth["vec_id"])]
    places = rows.where(F.col("vec_id").isin(ids)).select("curve", "vec_id", "rank").dropDuplicates(["curve", "vec_id"]).toPandas()
    rank = places.set_index(["curve", "vec_id"])["rank"]
    gap = pd.concat([(rank[c].loc[truth["query_id"]].reset_index(drop=True) - rank[c].loc[truth["vec_id"]].reset_index(drop=True)).abs() for c in sorted(places["curve"].unique())], axis=1).min(axis=1)
    return max(least, int(np.ceil(np.quantile(gap, recall))))


def smallest_ids(ids: DataFrame, most: int, salts: int = 256) -> DataFrame:
    """The ``most`` smallest vec_ids of each key of distinct (key, vec_id), first in each of ``salts`` parts of it."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    part = Window.partitionBy("key", "salt").orderBy("vec_id")
    some = ids.withColumn("salt", salt).withColumn("n", F.row_number().over(part)).where(F.col("n") <= most)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= most).select("key", "vec_id")


def units(own: DataFrame, every: int) -> DataFrame:
    """vec_id (a number of the unit, in order of its smallest id), key, asks and embedding of each distinct vector."""
    asks = F.max(F.col("vec_id") % every == 0).alias("asks")
    one = own.groupBy("key").agg(F.min("vec_id").alias("least"), asks, F.first("embedding").alias("embedding"))
    order = ["least", "key"]
    one = one.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(one.select(F.monotonically_increasing_id().alias("vec_id"), "key", "asks", "embedding"), "candidates")


def search(rows: DataFrame, k: int = 20, every: int = 20, curves: int = 12, dims: int = 6, bits: int = 8, block: int = 2048, recall: float = 0.96, sample: int = 200) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by ``every``."""
    own = usable_rows(rows).withColumn("key", content())
    ids = keep(own.select("key", "vec_id").distinct(), "ids")
    candidates = units(own, every)
    number = candidates.select(F.col("vec_id").alias("unit"), "key")
    kept = keep(smallest_ids(ids, k + 1).join(number, "key").select("unit", "vec_id"), "kept")
    vectors_of_id = ids.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    near = near_units(candidates, k * vectors_of_id, curves, dims, bits, block, recall, sample)  # ids may stand in several units
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    near = near.select("query_id", F.col("vec_id").alias("unit"), "score").union(candidates.where("asks").select("vec_id", "vec_id", norm))
    best = merge(near.join(kept, "unit").select("query_id", "vec_id", "score"), k + 1)
    lists = best.groupBy(F.col("query_id").alias("unit")).agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    queries = ids.where(F.col("vec_id") % every == 0).join(number, "key").select("unit", F.col("vec_id").alias("query_id"))
    found = queries.join(lists, "unit").select("query_id", F.explode("found").alias("f")).select("query_id", "f.*")
    return merge(found.where("vec_id != query_id"), k)


def near_units(candidates: DataFrame, k: int, curves: int, dims: int, bits: int, block: int, recall: float, sample: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest other units found of each unit that asks."""
    width, kind = width_of(candidates), raw_type(candidates)
    order = ranked(candidates, width, curves, dims, bits)
    half = fit_window(order, candidates, width, k, recall, sample, block // 2)
    ends = order.groupBy("curve").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    blocks = order.select(F.floor(F.col("rank") / block).alias("block"), "curve", "vec_id", "vector")
    asking = order.where("asks").join(F.broadcast(ends), "curve")  # one row for each curve
    low = F.floor(F.greatest(F.col("rank") - half, "first") / block)
    high = F.floor(F.least(F.col("rank") + half, "last") / block)
    asking = asking.select(F.col("curve").alias("on"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.explode(F.sequence(low, high)).alias("into"))

    def vectors(column):
        return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), width).astype(np.float64)

    def meet(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if there.empty or here.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = here["query_id"].to_numpy()
        at, ids, scores = nearest(vectors(here["query"]), there["vec_id"].to_numpy(), vectors(there["vector"]), own, k)
        return pd.DataFrame({"query_id": own[at], "vec_id": ids, "score": scores})

    return merge(blocks.groupBy("curve", "block").cogroup(asking.groupBy("on", "into")).applyInPandas(meet, NEAREST), k)
