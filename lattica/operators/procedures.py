"""Procedures for CALL: name -> DataFrame and the kinds of its columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import DST, ID, SRC, PropertyGraph
from lattica.operators import algorithms, optimize, vector
from lattica.plans.ast import CypherError

NAMES = (
    "algo.pageRank([label], [type], {iterations, damping})", "algo.wcc([label], [type])", "algo.scc([label], [type])", "algo.shortestPath(source, target, [type])", "algo.weightedPath(source, target, weight)",
    "algo.maxFlow(source, sink, capacity)", "algo.mst([weight])", "algo.triangleCount([label], [type], {cycles})", "algo.cdlp([label], [type], {maxIterations})", "algo.lcc([label], [type])", "algo.bfs(source, [type])", "algo.or.solve({...})",
)
HINTS = {"bfs": "shortestPath", "dijkstra": "weightedPath", "louvain": "cdlp", "connectedcomponents": "wcc", "labelpropagation": "cdlp"}


def projection(graph: PropertyGraph, label: str | None = None, type_: str | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a part of the graph; with a label, both ends of an edge must carry it."""
    vertices = graph.scan([label] if label else (), []).select(F.col(ID).alias("id"))
    edges = graph.scan_edges([type_] if type_ else (), [weight] if weight else [])
    w = [F.col(f"`{weight}`").alias("weight")] if weight and weight in edges.columns else []
    edges = edges.select(F.col(SRC).alias("src"), F.col(DST).alias("dst"), *w)
    if label:
        edges = edges.join(vertices.withColumnRenamed("id", "src"), "src", "left_semi").join(vertices.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return vertices, edges


def _split(args: list[Any]) -> tuple[str | None, str | None, dict]:
    words = [a for a in args if not isinstance(a, dict)]
    return (words[0] if words else None), (words[1] if len(words) > 1 else None), next((a for a in args if isinstance(a, dict)), {})


def call(lowerer: Any, name: str, args: list[Any]) -> tuple[DataFrame, dict[str, str]]:
    """Run a procedure. Names are case-insensitive, the namespace ``algo`` may be left out."""
    graph: PropertyGraph = lowerer.graph
    spark = graph.spark
    key = name.lower()
    if key == "db.labels":
        return spark.createDataFrame([(x,) for x in graph.labels()], "label string"), {}
    if key == "db.relationshiptypes":
        return spark.createDataFrame([(x,) for x in graph.types()], "relationshipType string"), {}
    if key == "db.propertykeys":
        return spark.createDataFrame([(x,) for x in graph.property_keys()], "propertyKey string"), {}
    if key == "db.schema.visualization":
        rows = sorted({(e.src_label or "", e.type, e.dst_label or "") for e in graph.edges})
        return spark.createDataFrame(rows, "source string, type string, target string"), {}
    if key == "db.index.vector.querynodes":
        if len(args) != 4:
            raise CypherError("Arity", "queryNodes(label, property, vector, k)")
        return vector.search(graph, args[0], args[1], list(args[2]), args[3]), {"node": "node"}
    short = key.removeprefix("algo.")
    label, type_, options = _split(args)
    node = lambda df: df.withColumnRenamed("id", "node")
    if short == "pagerank":
        v, e = projection(graph, label, type_)
        return node(algorithms.page_rank(v, e, float(options.get("damping", 0.85)), int(options.get("iterations", 20)), float(options.get("tolerance", 1e-4)), bool(options.get("dangling", True)))), {"node": "node"}
    if short == "wcc":
        return node(algorithms.components(*projection(graph, label, type_))), {"node": "node"}
    if short == "scc":
        return node(algorithms.strong_components(*projection(graph, label, type_))), {"node": "node"}
    if short == "cdlp":
        return node(algorithms.label_propagation(*projection(graph, label, type_), int(options.get("maxIterations", options.get("iterations", 100))))), {"node": "node"}
    if short == "lcc":
        return node(algorithms.clustering(*projection(graph, label, type_), bool(options.get("directed", False)))), {"node": "node"}
    if short == "trianglecount":
        return algorithms.triangle_count(projection(graph, label, type_)[1], bool(options.get("cycles", False))), {}
    if short == "shortestpath" and len(args) >= 2:
        return algorithms.cheapest_path(*projection(graph, None, args[2] if len(args) > 2 else None), int(args[0]), int(args[1])), {}
    if short == "weightedpath" and len(args) >= 3:
        return algorithms.cheapest_path(*projection(graph, None, None, args[2]), int(args[0]), int(args[1]), True), {}
    if short in ("bfs", "sssp") and args and isinstance(args[0], int):
        weight = args[1] if short == "sssp" and len(args) > 1 else None
        v, e = projection(graph, None, args[1] if short == "bfs" and len(args) > 1 else None, weight)
        return node(algorithms.distances(v, e, int(args[0]), weight is not None)), {"node": "node"}
    if short == "maxflow" and len(args) >= 2:
        return algorithms.max_flow(projection(graph, None, None, args[2] if len(args) > 2 else None)[1], int(args[0]), int(args[1])), {}
    if short == "mst":
        tree = algorithms.spanning_tree(*projection(graph, None, options.get("type"), label), bool(options.get("forest", False)))
        return tree.join(tree.agg(F.sum("weight").alias("total_weight")), F.lit(True)), {"source": "node", "target": "node"}
    if short == "or.solve":
        return optimize.procedure(graph, options), {}
    hint = f"; did you mean algo.{HINTS[short]}?" if short in HINTS else ""
    raise CypherError("UnknownProcedure", f"{name}{hint} Known: " + ", ".join(NAMES))
