"""Graphs over tables: labels from tables, relationships from foreign keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import DST, ID, ID_BITS, SRC, EdgeTable, NodeTable, PropertyGraph, pieces

#: Relationships get the upper half of the ids, so that they never meet a node's.
EDGE_SPACE = 1 << 62
#: Nodes and relationships that queries create take ids from here.
NEW_IDS = 1 << 61


@dataclass(frozen=True)
class NodeSpec:
    label: str
    table: str
    key: str
    props: tuple[str, ...] | None = None


@dataclass(frozen=True)
class EdgeSpec:
    """Relationships of a type: one per row of a table (or of the frame that ``make`` gives), from key columns to key columns.

    ``id`` names columns whose hash identifies a relationship; without it, the ends do, so that parallel ones are one.
    """

    type: str
    table: str
    src_label: str
    src_key: str
    dst_label: str
    dst_key: str
    props: tuple[str, ...] = ()
    id: tuple[str, ...] = ()
    make: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class GraphSpec:
    nodes: tuple[NodeSpec, ...]
    edges: tuple[EdgeSpec, ...] = field(default_factory=tuple)

    def node_id(self, label: str, key: Column) -> Column:
        """The ordinal of the label above the key: no lookup joins a foreign key to its node."""
        ordinal = next(k for k, n in enumerate(self.nodes) if n.label == label)
        return F.lit(ordinal << ID_BITS) + key.cast("long")

    def over(self, spark: SparkSession, read: Callable[[str], DataFrame]) -> PropertyGraph:
        """The graph over tables that ``read`` gives; nothing is read before a query needs it."""
        return PropertyGraph(spark, tuple(self._nodes(n, read) for n in self.nodes), tuple(self._edges(k, e, read) for k, e in enumerate(self.edges)), {"next_id": NEW_IDS})

    def _nodes(self, n: NodeSpec, read: Callable[[str], DataFrame]) -> NodeTable:
        def load() -> DataFrame:
            df = read(n.table)
            return df.select(self.node_id(n.label, F.col(n.key)).alias(ID), *(n.props if n.props is not None else df.columns))

        held = n.props is None or n.key in n.props
        return NodeTable(frozenset([n.label]), load, n.key if held else None, next(k for k, x in enumerate(self.nodes) if x is n) << ID_BITS)

    def _edges(self, k: int, e: EdgeSpec, read: Callable[[str], DataFrame]) -> EdgeTable:
        def load() -> DataFrame:
            df = read(e.table)
            df = e.make(df) if e.make else df.where(F.col(e.src_key).isNotNull() & F.col(e.dst_key).isNotNull())
            one = F.lit(EDGE_SPACE | (k << 56)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*(e.id or (e.src_key, e.dst_key))), 8))
            return df.select(one.alias(ID), self.node_id(e.src_label, F.col(e.src_key)).alias(SRC), self.node_id(e.dst_label, F.col(e.dst_key)).alias(DST), *e.props)

        keys = {(n.label, n.table, n.key) for n in self.nodes}
        single = {d for d, label, key in (("out", e.src_label, e.src_key), ("in", e.dst_label, e.dst_key)) if e.make is None and (label, e.table, key) in keys}
        return EdgeTable(e.type, load, e.src_label, e.dst_label, frozenset(single))


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _supplies(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n_lines"))


def _next(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("event_id", after.alias("next_id")).where("next_id is not null")


def _users(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct()


#: The star schema as a graph.
SHOP = GraphSpec(
    (
        NodeSpec("Region", "region", "r_regionkey"), NodeSpec("Nation", "nation", "n_nationkey"), NodeSpec("Customer", "customer", "c_custkey"), NodeSpec("Supplier", "supplier", "s_suppkey"),
        NodeSpec("Part", "part", "p_partkey"), NodeSpec("Order", "orders", "o_orderkey"), NodeSpec("Event", "events", "event_id"), NodeSpec("User", "users", "user_id"),
        NodeSpec("Document", "documents", "doc_id"), NodeSpec("Item", "benchmark", "item_id"), NodeSpec("Vec", "embeddings", "vec_id"),
    ),
    (
        EdgeSpec("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"), EdgeSpec("LIVES_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
        EdgeSpec("BASED_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"), EdgeSpec("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey"),
        EdgeSpec("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey", LINE[3:], LINE), EdgeSpec("SUPPLIED_BY", "lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey", ("l_quantity", "l_extendedprice"), LINE),
        EdgeSpec("SUPPLIES", "lineitem", "Supplier", "l_suppkey", "Part", "l_partkey", ("n_lines",), make=_supplies), EdgeSpec("DID", "events", "User", "user_id", "Event", "event_id"),
        EdgeSpec("NEXT", "events", "Event", "event_id", "Event", "next_id", make=_next),
    ),
)


def shop_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph over the Parquet tables in a folder."""

    @cache
    def read(name: str) -> DataFrame:
        return _users(read("events")) if name == "users" else spark.read.parquet(f"{folder}/{name}.parquet")

    return SHOP.over(spark, read)


def co_purchase(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    """(src, dst, weight): parts a < b that were bought in ``least`` orders at least together.

    Partitions grow in number with the rows, not in size. Pairs hardly repeat within one, so they travel as they are.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey")
    n = pieces(spark, lines.count())
    lines = lines.repartition(n, "l_orderkey").distinct()
    other = lines.withColumnRenamed("l_partkey", "b")
    pairs = lines.join(other, "l_orderkey").where("l_partkey < b").select(F.col("l_partkey").alias("src"), F.col("b").alias("dst"))
    return pairs.repartition(2 * n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
