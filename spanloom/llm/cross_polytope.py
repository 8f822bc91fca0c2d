"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash of a vector is the signed axis nearest to it after three rounds of random signs and
a Walsh-Hadamard transform; a table's bucket joins ``axes`` such hashes. Each vector stands
in its own bucket of each table and in the next best ones (multiprobe), and meets those that
stand in their own there. Met pairs are verified by cosine in double precision.

How many tables are needed so that a pair exactly at the threshold is met with the asked
probability is found by a small simulation that depends on neither the data nor their size;
closer pairs are met more surely still. ``axes`` grows with the logarithm of the row count,
which keeps the mean bucket at a few rows.

A pair may meet in several buckets. Each row carries its buckets of all tables, so that a
pair is counted only in the first bucket in which it meets: no table of pairs is made, a
bucket yields a count for each row and a spanning forest of its links. Buckets above
``block`` rows are cut into blocks and each pair of blocks is a task of its own. Copies of a
vector are one class and count by their number.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and keep a row with no links, their own component. So do rows without an id, with a
null component. Vectors of unequal length compare as if filled up with zeros. Rows that
repeat an id are vectors of their own: links and components are those of the vector, so that
two rows of one id may differ in both. Doubles stay doubles. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import keep
from spanloom.llm.components import connected_components, forest
from spanloom.llm.vectors import content, numbers, raw_type, usable, width_of

SEED = 20240
#: Into how many parts the vectors of a component are dealt for the join with its smallest id.
SALTS = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@functools.lru_cache(maxsize=8)
def signs(width: int, tables: int, axes: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(tables, axes, 3, width))


def buckets(unit: np.ndarray, tables: int, axes: int, probes: int) -> np.ndarray:
    """Bucket numbers, rows x tables x probes: the own bucket, then the next best ones.

    A probe's loss is the sum over its hashes of the squared step down from the largest coordinate.
    """
    rows, width = unit.shape
    out = np.full((rows, tables, probes), -1, dtype=np.int64)  # -1: there are fewer buckets than probes
    top = min(probes, width)
    for t in range(tables):
        code, loss = np.zeros((rows, 1), dtype=np.int64), np.zeros((rows, 1))
        for a in range(axes):
            x = unit
            for s in signs(width, tables, axes)[t, a]:
                x = hadamard(x * s)
            size = np.abs(x)
            best = np.argsort(-size, axis=1, kind="stable")[:, :top]
            own = np.take_along_axis(size, best, 1)
            step = (own[:, :1] - own) ** 2
            axis = best * 2 + (np.take_along_axis(x, best, 1) > 0)
            code = (code[:, :, None] * (2 * width) + axis[:, None, :]).reshape(rows, -1)
            loss = (loss[:, :, None] + step[:, None, :]).reshape(rows, -1)
            first = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, first, 1), np.take_along_axis(loss, first, 1)
        out[:, t, : code.shape[1]] = code
    return out


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows meet, given their buckets (... x probes) in one table."""
    return (a[..., :1] == b).any(-1) | (b[..., :1] == a).any(-1)


@functools.lru_cache(maxsize=32)
def tables_for(width: int, axes: int, probes: int, least: float, miss: float) -> int:
    """Tables after which a pair at cosine ``least`` is missed with probability ``miss`` or less."""
    rng = np.random.default_rng(SEED + 1)
    x = rng.normal(size=(2000, width))
    y = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = least * x + math.sqrt(1 - least**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    hit = met(buckets(x, 4, axes, probes), buckets(y, 4, axes, probes)).mean()
    return max(2, math.ceil(math.log(miss) / math.log(1 - min(0.999, hit))))


def counted(here: int, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows with buckets a and b (pairs x tables x probes): whether bucket ``here`` of ``table`` is the first in which it meets."""
    before = met(a[:, :table], b[:, :table]).any(1)
    x, y = a[:, table], b[:, table]
    also = np.where((y == x[:, :1]).any(1), x[:, 0], np.iinfo(np.int64).max)  # b stands in a's own bucket
    also = np.minimum(also, np.where((x == y[:, :1]).any(1), y[:, 0], np.iinfo(np.int64).max))
    return ~before & (also == here)


def links(frame: pd.DataFrame, least: float, tables: int, probes: int, width: int, kind: str = "<f4", parts: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links first met in this bucket: number of partners of each row (copies counted), and a spanning forest."""
    table, here = int(frame["tab"].iloc[0]), int(frame["bucket"].iloc[0])
    x = np.frombuffer(b"".join(frame["vector"]), dtype=kind).reshape(len(frame), width).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = np.frombuffer(b"".join(frame["codes"]), dtype="<i8").reshape(len(frame), tables, probes)
    rep, size, own = frame["rep"].to_numpy(), frame["size"].to_numpy(), frame["own"].to_numpy()
    part = frame["part"].to_numpy() if parts else None
    n, us, vs = np.zeros(len(frame), dtype=np.int64), [], []
    for k in range(0, len(frame), 1024):
        near = x[k : k + 1024] @ x.T >= least
        near &= own[k : k + 1024, None] | own[None, :]
        if parts and parts[0] != parts[1]:
            near &= part[k : k + 1024, None] != part[None, :]
        i, j = np.nonzero(np.triu(near, k + 1))
        for c in range(0, len(i), 1 << 16):
            p, q = i[c : c + (1 << 16)] + k, j[c : c + (1 << 16)]
            first = counted(here, table, codes[p], codes[q])
            p, q = p[first], q[first]
            np.add.at(n, p, size[q])
            np.add.at(n, q, size[p])
            u, v = forest(rep[p], rep[q])
            us.append(u)
            vs.append(v)
    u, v = forest(np.concatenate(us or [rep[:0]]), np.concatenate(vs or [rep[:0]]))
    return n, u, v


def found(frame: pd.DataFrame, *rule, parts=None) -> pd.DataFrame:
    n, u, v = links(frame, *rule, parts=parts)
    some = n > 0
    none = pd.array([None] * int(some.sum()), dtype="Int64")
    return pd.concat([pd.DataFrame({"u": frame["rep"].to_numpy()[some], "v": none, "n": n[some]}), pd.DataFrame({"u": u, "v": pd.array(v, dtype="Int64"), "n": 0})])


def near_vectors(rows: DataFrame, least: float = 0.9, miss: float = 0.0005, probes: int = 3, axes: int | None = None, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``rows`` (vec_id, embedding)."""
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), numbers(rows))
    every = every.withColumn("key", F.when(F.col("vec_id").isNotNull() & usable(), content()))
    part_taking = every.where("key is not null")
    one = part_taking.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = keep(one.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a number of the vector: its id may be another's too
    kind = raw_type(classes)
    width = 1 << max(0, width_of(classes) - 1).bit_length()
    axes = axes or max(1, round(math.log(max(classes.count(), 2)) / math.log(2 * width)))
    tables = tables_for(width, axes, probes, least, miss)
    rule = (least, tables, probes, width, kind)

    def deal(batches):
        for batch in batches:
            for k in range(0, len(batch), 2048):
                some = batch.iloc[k : k + 2048]
                raw = np.zeros((len(some), width), dtype=kind)
                for r, v in enumerate(some["embedding"]):
                    raw[r, : len(v)] = v
                unit = raw.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                codes = buckets(unit, tables, axes, probes)
                stored, vector = [c.astype("<i8").tobytes() for c in codes], [v.tobytes() for v in raw]
                for t in range(tables):
                    for p in range(probes):
                        if codes[0, t, p] < 0:
                            continue
                        yield pd.DataFrame({"tab": t, "bucket": codes[:, t, p], "own": p == 0, "rep": some["rep"].to_numpy(), "size": some["size"].to_numpy(), "codes": stored, "vector": vector})

    schema = "tab int, bucket long, own boolean, rep long, size long, codes binary, vector binary"
    dealt = classes.select("rep", "size", "embedding").mapInPandas(deal, schema)
    crowded = keep(dealt.groupBy("tab", "bucket").count().where(F.col("count") > block), "crowded")

    def stream(batches):
        held = None
        for batch in batches:
            now = batch if held is None else pd.concat([held, batch], ignore_index=True)
            code = now["tab"].to_numpy().astype(np.int64) * (1 << 48) ^ now["bucket"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    yield found(now.iloc[a:b], *rule)
            held = now.iloc[starts[-1] :]
        if held is not None and len(held) > 1:
            yield found(held, *rule)

    few = dealt.join(crowded.select("tab", "bucket"), ["tab", "bucket"], "left_anti")
    out = "u long, v long, n long"
    by_bucket = few.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket").mapInPandas(stream, out)

    parts = F.ceil(F.col("count") / block).cast("int")
    many = dealt.join(crowded, ["tab", "bucket"]).withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    many = many.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def pair(key, frame):
        return found(frame, *rule, parts=(key[2], key[3]))

    by_part = many.groupBy("tab", "bucket", "low", "high").applyInPandas(pair, out)
    result = keep(by_bucket.union(by_part), "links")
    counts = result.groupBy("u").agg(F.sum("n").alias("n"))
    component = connected_components(result.where("v is not null").select("u", "v"))
    labelled = classes.join(counts, classes.rep == counts.u, "left").join(component, classes.rep == component.node, "left")
    labelled = labelled.select("key", "least", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("label"), F.pmod("rep", F.lit(SALTS)).alias("salt"))
    labelled = keep(labelled, "labelled")
    lowest = labelled.groupBy("label").agg(F.min("least").alias("smallest"), F.count("*").alias("m")).where("m > 1")
    lowest = lowest.select("label", "smallest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a component may hold a third of all
    labelled = labelled.join(lowest, ["label", "salt"], "left").select("key", "links", F.coalesce("smallest", "least").alias("smallest"))
    joined = every.select("vec_id", "key").join(labelled, "key", "left")
    joined = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
