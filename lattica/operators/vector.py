"""Exact nearest-neighbour search over vector properties, as expressions and a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import ID, PropertyGraph
from lattica.plans.ast import CypherError

METRICS = ("cosine", "l2", "inner")


def distance(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Distance of a vector column to a constant, ascending: nearer is less. Cosine: 0 to 1, 1 for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    fold = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    dot = fold(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "inner":
        return F.lit(1.0) - dot
    if metric == "l2":
        return F.sqrt(fold(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    norm = F.sqrt(fold(F.transform(v, lambda a: a * a))) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    similar = F.when(norm > 0, F.least(F.greatest(dot / norm, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1.0) - similar, F.lit(0.0))


def search(graph: PropertyGraph, label: str, prop: str, query: list[float], k: int) -> DataFrame:
    """(node, score): the k nearest nodes; ties go to the lesser id. The metric is the index's, cosine without one."""
    index = graph.meta.get("vectors", {}).get((label, prop), {})
    metric = {"euclidean": "l2", "dot": "inner", "inner_product": "inner"}.get(str(index.get("similarity", "cosine")).lower(), str(index.get("similarity", "cosine")).lower())
    if k <= 0 or not query:
        raise CypherError("InvalidArgument", "k and the vector must not be empty")
    if index and index["dimensions"] != len(query):
        raise CypherError("DimensionMismatch", f"the index on {label}.{prop} has dimensions {index['dimensions']}, the vector {len(query)}")
    if metric not in METRICS:
        raise CypherError("InvalidOption", f"similarity {metric}")
    rows = graph.scan([label], [prop])
    if prop not in rows.columns:
        return graph.spark.createDataFrame([], "node long, score double")
    rows = rows.where(F.size(F.col(f"`{prop}`")) == len(query))
    scored = rows.select(F.col(ID).alias("node"), distance(F.col(f"`{prop}`"), query, metric).alias("score"))
    return scored.orderBy("score", "node").limit(int(k))


def chunks(df: DataFrame, column: str, size: int, overlap: int) -> DataFrame:
    """One row per window of ``size`` characters that overlap by ``overlap``: columns chunk (from 0) and text."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(column) - 1 - F.lit(overlap), F.lit(0)), F.lit(step))
    return df.withColumn("_s", F.explode(starts)).withColumns({"chunk": (F.col("_s") / step).cast("int"), "text": F.substring(F.col(column), F.col("_s") + 1, F.lit(size))}).drop("_s")


def search_all(graph: PropertyGraph, query: list[float], k: int) -> DataFrame:
    """(label, property, node, score): the k nearest over every index of the query's dimensions."""
    found = [search(graph, label, prop, query, k).select(F.lit(label).alias("label"), F.lit(prop).alias("property"), "node", "score") for (label, prop), i in sorted(graph.meta.get("vectors", {}).items()) if i["dimensions"] == len(query)]
    if not found:
        return graph.spark.createDataFrame([], "label string, property string, node long, score double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy("score", "label", "node").limit(int(k))
