"""Graphs from and to files: CSV and JSON nodes, snapshots in Parquet, JSON-lines interchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import DST, ID, SRC, EdgeTable, NodeTable, PropertyGraph, indexed, stacked
from lattica.plans.ast import CypherError


def _as_nodes(graph: PropertyGraph, df: DataFrame, label: str, id_column: str | None) -> PropertyGraph:
    if id_column:
        rows = df.select(F.col(id_column).cast("long").alias(ID), *[F.col(f"`{c}`") for c in df.columns])
    else:
        rows = indexed(df, ID, graph.next_id()).select(ID, *[F.col(f"`{c}`") for c in df.columns])
    return graph.with_nodes([*graph.nodes, NodeTable(frozenset([label]), rows)])


def import_csv(graph: PropertyGraph, path: str, label: str, id_column: str | None = None, delimiter: str = ",", schema: T.StructType | None = None) -> PropertyGraph:
    """Nodes of one label from CSV with a header; quoted fields may hold delimiters and line ends."""
    reader = graph.spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"')
    return _as_nodes(graph, (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path), label, id_column)


def import_json(graph: PropertyGraph, path: str, label: str, id_column: str | None = None, schema: T.StructType | None = None, lines: bool = False) -> PropertyGraph:
    """Nodes of one label from an array of JSON objects, or from one object per line."""
    reader = graph.spark.read.option("multiLine", not lines)
    return _as_nodes(graph, (reader.schema(schema) if schema else reader).json(path), label, id_column)


def _definitions(graph: PropertyGraph) -> dict:
    """Indexes, constraints, vector indexes and hierarchies as JSON can hold them. Closures are derived again when asked for."""
    meta = graph.meta
    return {
        "indexes": [list(x) for x in meta.get("indexes", [])], "unique": [list(x) for x in meta.get("unique", [])], "hierarchies": list(meta.get("hierarchies", {}).values()),
        "vectors": [{"of": list(k), "as": v} for k, v in meta.get("vectors", {}).items()], "next_id": meta.get("next_id"),
    }


def _meta(d: dict) -> dict:
    """What ``_definitions`` wrote, as a graph's meta."""
    out: dict = {"indexes": [tuple(x) for x in d.get("indexes", [])], "unique": [tuple(x) for x in d.get("unique", [])]}
    out["vectors"] = {tuple(v["of"]): v["as"] for v in d.get("vectors", [])}
    out["hierarchies"] = {h["name"]: h | {"measure": tuple(h["measure"]) if h.get("measure") else None} for h in d.get("hierarchies", [])}
    out = {k: v for k, v in out.items() if v}
    return out | ({"next_id": d["next_id"]} if d.get("next_id") is not None else {})


def save_snapshot(graph: PropertyGraph, path: str) -> None:
    """One Parquet folder per set of labels and per type, and a manifest with the definitions, written last: without it there is no snapshot."""
    nodes, edges = [], []
    for k, t in enumerate(graph.nodes):
        t.df.write.mode("overwrite").parquet(f"{path}/nodes-{k}")
        nodes.append({"labels": sorted(t.labels), "path": f"nodes-{k}"})
    for k, e in enumerate(graph.edges):
        e.df.write.mode("overwrite").parquet(f"{path}/edges-{k}")
        edges.append({"type": e.type, "path": f"edges-{k}", "src": e.src_label, "dst": e.dst_label})
    text = json.dumps({"version": 2, "nodes": nodes, "edges": edges, "definitions": _definitions(graph)})
    graph.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph of a snapshot with its definitions; a folder without a manifest is refused as a whole."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    nodes = tuple(NodeTable(frozenset(n["labels"]), spark.read.parquet(f"{path}/{n['path']}")) for n in manifest["nodes"])
    edges = tuple(EdgeTable(e["type"], spark.read.parquet(f"{path}/{e['path']}"), e["src"], e["dst"]) for e in manifest["edges"])
    return PropertyGraph(spark, nodes, edges, _meta(manifest.get("definitions", {})))


def export_jsonl(graph: PropertyGraph, path: str) -> None:
    """Gzipped JSON lines: {"t": "n", id, labels, props}, {"t": "e", id, src, tgt, type, props} and one {"t": "h", version, counts, labels, types, definitions}."""
    rows = [t.df.select(F.to_json(F.struct(F.lit("n").alias("t"), F.col(ID).alias("id"), F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>").alias("labels"), F.struct(*[F.col(f"`{p}`") for p in t.props] or [F.lit(None).alias("_")]).alias("props"))).alias("value")) for t in graph.nodes]
    rows += [e.df.select(F.to_json(F.struct(F.lit("e").alias("t"), F.col(ID).alias("id"), F.col(SRC).alias("src"), F.col(DST).alias("tgt"), F.lit(e.type).alias("type"), F.struct(*[F.col(f"`{p}`") for p in e.props] or [F.lit(None).alias("_")]).alias("props"))).alias("value")) for e in graph.edges]
    head = {
        "t": "h", "version": 2, "node_count": sum(t.df.count() for t in graph.nodes), "edge_count": sum(e.df.count() for e in graph.edges), "labels": graph.labels(), "edge_types": graph.types(),
        "definitions": _definitions(graph),
    }
    out = graph.spark.createDataFrame([(json.dumps(head),)], "value string")
    for r in rows:
        out = out.unionByName(r)
    out.write.mode("overwrite").option("compression", "gzip").text(path)


def import_jsonl(spark: SparkSession, path: str, dedup_key: str | None = None) -> PropertyGraph:
    """The graph of JSON lines; property types are inferred per label set and type. The far end of a relationship is ``tgt`` or ``dst``; lines of other kinds than nodes, relationships and heads are ignored.

    Where a head counts nodes and relationships, a file that holds others (one cut short, say) is refused as a whole.

    With ``dedup_key``, nodes of the same labels whose key is equal after trimming and lower-casing are one, the least id stays, and
    relationships are moved to it.
    """
    raw = spark.read.text(path)
    kind = F.get_json_object("value", "$.t")
    heads = [json.loads(r[0]) for r in raw.where(kind == "h").limit(2).collect()]
    if heads and "node_count" in heads[0]:
        have = raw.agg(F.count_if(kind == "n"), F.count_if(kind == "e")).first()
        if tuple(have) != (heads[0]["node_count"], heads[0]["edge_count"]):
            raise CypherError("BrokenSnapshot", f"{tuple(have)} nodes and relationships where the head counts {heads[0]['node_count']} and {heads[0]['edge_count']}")
    labels = sorted(r[0] or "[]" for r in raw.where(kind == "n").select(F.get_json_object("value", "$.labels")).distinct().collect())  # label sets, not rows
    types = sorted(r[0] for r in raw.where(kind == "e").select(F.get_json_object("value", "$.type")).distinct().collect())
    nodes, edges = [], []
    for x in labels:
        part = raw.where((kind == "n") & (F.coalesce(F.get_json_object("value", "$.labels"), F.lit("[]")) == x)).select(F.get_json_object("value", "$.id").cast("long").alias(ID), F.get_json_object("value", "$.props").alias("p"))
        nodes.append(NodeTable(frozenset(json.loads(x)), _props(part, [ID])))
    for x in types:
        part = raw.where((kind == "e") & (F.get_json_object("value", "$.type") == x)).select(*[F.get_json_object("value", f"$.{a}").cast("long").alias(b) for a, b in (("id", ID), ("src", SRC))], F.coalesce(F.get_json_object("value", "$.tgt"), F.get_json_object("value", "$.dst")).cast("long").alias(DST), F.get_json_object("value", "$.props").alias("p"))
        edges.append(EdgeTable(x, _props(part, [ID, SRC, DST])))
    if dedup_key:
        moved, kept = [], []
        for t in nodes:
            if dedup_key not in t.props:
                kept.append(t)
                continue
            clean = F.lower(F.trim(F.col(f"`{dedup_key}`").cast("string")))
            least = t.df.where(clean.isNotNull()).groupBy(clean.alias("__key")).agg(F.min(ID).alias("to"))
            named = t.df.join(least, clean == F.col("__key")).select(F.col(ID).alias("from"), "to")
            moved.append(named.where("`from` <> to"))
            kept.append(NodeTable(t.labels, t.df.join(moved[-1].select(F.col("from").alias(ID)), ID, "left_anti").select(t.df.columns)))
        if moved:
            to = stacked(moved)
            out = []
            for e in edges:
                df = e.df
                for end in (SRC, DST):
                    df = df.join(to, df[end] == to["from"], "left").withColumn(end, F.coalesce("to", end)).drop("from", "to")
                out.append(EdgeTable(e.type, df.select(e.df.columns)))
            nodes, edges = kept, out
    return PropertyGraph(spark, tuple(nodes), tuple(edges), _meta(heads[0].get("definitions", {})) if heads else {})


def _props(df: DataFrame, fixed: list[str]) -> DataFrame:
    """Properties from a JSON column ``p``, typed by inference over all rows."""
    inferred = df.sparkSession.read.json(df.select("p").where("p is not null").rdd.map(lambda r: r[0]))
    names = [c for c in inferred.columns if c != "_"]
    if not names:
        return df.select(*fixed)
    return df.withColumn("s", F.from_json("p", inferred.schema)).select(*fixed, *[F.col("s")[n].alias(n) for n in names])
