"""Connected components of an edge table, by alternating stars.

Each round rewrites the edges so that every node points at the least node it knows: the large star
links each greater neighbour of a node to the least node around it, the small star links each lesser one. The
number of rounds grows with the logarithm of the longest chain. Nothing is collected but two numbers
a round; each round is checkpointed to the shared folder. Tables that one task can hold need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, in_arrow


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    flip = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(flip) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the least node reachable.

    Null ends and self-loops are ignored; an empty table gives an empty one.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    state = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = state.select(sign.alias("s")).first()["s"]
    while before[0]:
        state = cut(_star(_star(state, True), False))
        after = state.select(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least one that it reaches by the edges (a, b)."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (least node, other) that reach what the edges (u, v) do."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = least_reached(len(node), at[: len(u)], at[len(u) :])
    other = np.flatnonzero(root < np.arange(len(node)))
    return node[root[other]], node[other]


def joined(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """As ``components``, for edges(u, v) without nulls: up to about ``most`` edges are one task's, of more each task reduces its share to stars before the rounds."""
    edges = cut(edges)
    tasks = max(1, -(-edges.count() // most))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if both:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*both, strict=True)))], ["u", "v"])

    reduced = cut(in_arrow(edges.coalesce(tasks), reduce, "u long, v long"))
    if tasks > 1:
        return components(reduced)
    return reduced.select(F.col("v").alias("node"), F.col("u").alias("root")).union(reduced.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
