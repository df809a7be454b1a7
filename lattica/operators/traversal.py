"""Traversals of unbounded or variable length, as bounded iterations of joins.

Each level is one join of the frontier with the relationships (which stay where they are while the frontier is small), an
anti join against what was reached before, and a checkpoint to the shared folder; the loop ends when the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import DST, ID, SRC, checkpointed, meeting

#: Levels that are unrolled into one plan before lineage is cut.
UNROLLED = 3


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, e): one step from a to b over edge e."""
    out = edges.select(F.col(SRC).alias("a"), F.col(DST).alias("b"), F.col(ID).alias("e"))
    if direction == "out":
        return out
    back = edges.select(F.col(DST).alias("a"), F.col(SRC).alias("b"), F.col(ID).alias("e"))
    return back if direction == "in" else out.unionByName(back.where("a <> b"))


def reach(starts: DataFrame, edges: DataFrame, direction: str, low: int, high: int | None, trace: bool = False) -> DataFrame:
    """(s, n[, nodes, rels]): nodes whose least distance from s is within the bounds, once per s.

    ``starts`` has one column s. With ``trace``, the path that is least by its edge ids among the shortest ones is
    carried along. The source itself is reached at distance 0 only.
    """
    step = steps(edges, direction)
    step = step.groupBy("a", "b").agg(F.min("e").alias("e")) if trace else step.select("a", "b")
    first = starts.where("s is not null").distinct().select("s", F.col("s").alias("n"), F.lit(0).alias("d"))
    if trace:
        first = first.withColumn("nodes", F.array("s")).withColumn("rels", F.array().cast("array<bigint>"))
    cut = high is None or high > UNROLLED
    if cut:
        step, first = checkpointed(step), checkpointed(first)
    seen, frontier, d = first, first, 0
    rows = first.count() if cut else None
    while high is None or d < high:
        d += 1
        met = meeting(frontier, "n", step, "a", rows) if cut else frontier.join(step, frontier["n"] == step["a"])
        if trace:
            nexts = met.select("s", F.col("b").alias("n"), F.lit(d).alias("d"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("rels", F.array("e")).alias("rels"))
            best = F.min(F.struct("rels", "nodes")).alias("best")
            nexts = nexts.groupBy("s", "n", "d").agg(best).select("s", "n", "d", "best.nodes", "best.rels")
        else:
            nexts = met.select("s", F.col("b").alias("n"), F.lit(d).alias("d")).distinct()
        frontier = nexts.join(seen.select("s", "n"), ["s", "n"], "left_anti").select(nexts.columns)
        if cut:
            frontier = checkpointed(frontier)
            rows = frontier.count()
            if not rows:
                break
        seen = seen.unionByName(frontier)
        if cut and d % 8 == 0:
            seen = checkpointed(seen)
    return seen.where(F.col("d") >= low).drop("d")


def shortest(pairs: DataFrame, edges: DataFrame, direction: str, every: bool, low: int = 0, high: int | None = None) -> DataFrame:
    """(s, t, nodes, rels): one shortest path, or every one, for each of ``pairs(s, t)`` that is connected.

    Equal ends give one path of length 0. The search keeps, for each source and node, the last steps of its shortest paths (of
    one: the step of the least edge id); paths are only put together backwards from the targets asked for. A source
    leaves the search once all of its targets are reached.
    """
    step = steps(checkpointed(edges.select(ID, SRC, DST)), direction)
    pairs = checkpointed(pairs.where("s is not null and t is not null").distinct())
    empty = F.array().cast("array<bigint>")
    frontier = pairs.select("s", F.col("s").alias("n")).distinct()
    seen, last, hits = frontier, [], []
    open_ = pairs.where("s <> t")
    while (high is None or len(last) < high) and not open_.isEmpty():
        frontier = checkpointed(frontier.join(open_.select("s").distinct(), "s", "left_semi"))
        nexts = meeting(frontier, "n", step, "a", frontier.count()).select("s", F.col("b").alias("n"), "a", "e").join(seen, ["s", "n"], "left_anti")
        if not every:
            nexts = nexts.groupBy("s", "n").agg(F.min(F.struct("e", "a")).alias("m")).select("s", "n", "m.a", "m.e")
        last.append(checkpointed(nexts.select("s", "n", "a", "e")))
        frontier = last[-1].select("s", "n").distinct()
        if last[-1].isEmpty():
            last.pop()
            break
        seen = checkpointed(seen.union(frontier))
        hits.append(checkpointed(open_.join(frontier.withColumnRenamed("n", "t"), ["s", "t"], "left_semi")))
        open_ = checkpointed(open_.join(hits[-1], ["s", "t"], "left_anti"))
    walk = pairs.select("s", "t", F.col("t").alias("n"), F.array("t").alias("nodes"), empty.alias("rels")).limit(0)
    for d in range(len(hits), 0, -1):
        if d >= low:
            walk = walk.unionByName(hits[d - 1].select("s", "t", F.col("t").alias("n"), F.array("t").alias("nodes"), empty.alias("rels")))
        back = walk.join(last[d - 1], ["s", "n"]).select("s", "t", F.col("a").alias("n"), F.concat(F.array("a"), "nodes").alias("nodes"), F.concat(F.array("e"), "rels").alias("rels"))
        walk = checkpointed(back) if d % UNROLLED == 0 else back
    out = walk.select("s", "t", "nodes", "rels")
    return out.unionByName(pairs.where("s = t").select("s", "t", F.array("s").alias("nodes"), empty.alias("rels"))) if low <= 1 else out
