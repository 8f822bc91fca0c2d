"""Connected components of an edge table, as alternating star contractions in Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import forget, keep

EDGES = "u long, v long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that these edges reach; nodes that are their own smallest have none."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges, in pieces of bounded size."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
            rows += len(batch)
            if rows > 1 << 20:
                held = [forest(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > 1 << 19:
                    yield pd.DataFrame({"u": held[0][0], "v": held[0][1]})
                    held = []
                rows = len(held[0][0]) if held else 0
        if held:
            u, v = forest(*(np.concatenate(x) for x in zip(*held)))
            yield pd.DataFrame({"u": u, "v": v})

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u != v").mapInPandas(run, EDGES)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component, the smallest node reachable, of each node of ``edges`` (u, v) that is not its own smallest.

    Each round links every larger neighbour of a node to the node's smallest neighbour, then
    every node to its smallest smaller neighbour. The table of edges never grows, and the
    rounds end when it no longer changes. Each round is written to the shared folder, and
    the one before it deleted.
    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    now = keep(contract(edges), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        former, now = now, keep(small.select("e.*").where("u != v").distinct(), "edges")
        forget(former)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError(f"no end after {rounds} rounds")
