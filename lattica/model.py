"""The property graph: one DataFrame per set of node labels and per relationship type."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of identity; every other column of a table is a property.
ID, SRC, DST = "__id", "__src", "__dst"
#: Node ids are the ordinal of their label shifted by this many bits, plus the source key.
ID_BITS = 48
#: Rows of a partition that is sorted, joined or aggregated in one task.
PIECE = 250_000
#: Rows that go to every executor rather than make a larger side of a join travel.
LIGHT = 500_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def pieces(spark: SparkSession, rows: int) -> int:
    """How many partitions to deal so many rows to: a task's memory stays the same as they grow."""
    return max(-(-rows // PIECE), min(spark.sparkContext.defaultParallelism, -(-rows // 10_000)), 1)


def meeting(few: DataFrame, n: str, many: DataFrame, a: str, rows: int) -> DataFrame:
    """The join of a frontier of ``rows`` rows with all relationships on n = a: unless it is large itself, the frontier is what travels."""
    return (F.broadcast(few) if rows <= LIGHT else few).join(many, few[n] == many[a])


def indexed(df: DataFrame, column: str, first: int = 0) -> DataFrame:
    """Number rows from ``first`` without moving them: counts per partition are summed on the driver, one row per partition."""
    df = checkpointed(df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1], r[2]) for r in df.groupBy("__part").agg(F.count("*"), F.min("__row")).collect())
    shift, total = {}, first
    for part, n, low in counts:
        shift[part] = total - low
        total += n
    if not shift:
        return df.withColumn(column, F.lit(None).cast("long")).drop("__part", "__row")
    by_part = F.create_map(*[F.lit(x) for p, s in shift.items() for x in (p, s)])
    return df.withColumn(column, F.col("__row") + F.element_at(by_part, F.col("__part"))).drop("__part", "__row")


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: numbers widen, everything else that differs becomes text."""
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in order and b in order:
        return order[max(order.index(a), order.index(b))]
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widened(a.elementType, b.elementType))
    return T.StringType()


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null, columns of different types are widened."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = widened(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    even = [df.select(*[(F.col(f"`{c}`").cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]) for df in frames]
    return reduce(DataFrame.union, even)


class Table:
    """Something with rows that are read when they are first asked for."""

    load: DataFrame | Callable[[], DataFrame]

    @property
    def df(self) -> DataFrame:
        if callable(self.load):
            object.__setattr__(self, "load", self.load())
        return self.load


@dataclass(frozen=True)
class NodeTable(Table):
    """Nodes with the same labels. Where ids are a source key above ``base``, ``key`` names its column."""

    labels: frozenset[str]
    load: DataFrame | Callable[[], DataFrame]
    key: str | None = None
    base: int = 0

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != ID]

    def of_ids(self, ids: Iterable[int]) -> NodeTable:
        """The nodes of some ids, found by their key if there is one: a filter that reaches the scan."""
        if self.key is None:
            return self
        keys = [i - self.base for i in ids if 0 <= i - self.base < 1 << ID_BITS]
        return replace(self, load=self.df.where(F.col(f"`{self.key}`").isin(keys) if keys else F.lit(False)))


@dataclass(frozen=True)
class EdgeTable(Table):
    """Relationships of one type; ends that are known to carry certain labels may say so.

    ``single`` names the directions in which a node should have one such relationship at most: what plans go by, nothing that results rest on.
    """

    type: str
    load: DataFrame | Callable[[], DataFrame]
    src_label: str | None = None
    dst_label: str | None = None
    single: frozenset[str] = frozenset()

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in (ID, SRC, DST)]


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable graph. Writing gives a new one; ``meta`` holds definitions of indexes and constraints."""

    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    meta: dict[str, Any] = field(default_factory=dict)

    def with_nodes(self, nodes: Iterable[NodeTable]) -> PropertyGraph:
        return replace(self, nodes=tuple(nodes))

    def with_edges(self, edges: Iterable[EdgeTable]) -> PropertyGraph:
        return replace(self, edges=tuple(edges))

    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes for x in t.labels})

    def types(self) -> list[str]:
        return sorted({t.type for t in self.edges})

    def property_keys(self) -> list[str]:
        return sorted({p for t in (*self.nodes, *self.edges) for p in t.props})

    def node_tables(self, labels: Iterable[str] = ()) -> list[NodeTable]:
        want = set(labels)
        return [t for t in self.nodes if want <= t.labels]

    def edge_tables(self, types: Iterable[str] = ()) -> list[EdgeTable]:
        want = set(types)
        return [t for t in self.edges if not want or t.type in want]

    def props_of(self, labels: Iterable[str] = ()) -> list[str]:
        return sorted({p for t in self.node_tables(labels) for p in t.props})

    def scan(self, labels: Iterable[str] = (), props: Iterable[str] | None = None) -> DataFrame:
        """(__id, __labels, properties) of the nodes that carry all ``labels``."""
        tables = self.node_tables(labels)
        keep = set(self.props_of(labels) if props is None else props)
        frames = [t.df.select(F.col(ID).cast("long").alias(ID), F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>").alias("__labels"), *[F.col(f"`{p}`") for p in t.props if p in keep]) for t in tables]
        if not frames:
            return self.spark.createDataFrame([], f"`{ID}` long, `__labels` array<string>")
        return stacked(frames) if len(frames) > 1 else frames[0]

    def scan_edges(self, types: Iterable[str] = (), props: Iterable[str] | None = None) -> DataFrame:
        """(__id, __src, __dst, __type, properties) of the relationships of any of ``types`` (none: of all)."""
        frames = [t.df.select(*[F.col(c).cast("long").alias(c) for c in (ID, SRC, DST)], F.lit(t.type).alias("__type"), *[F.col(f"`{p}`") for p in t.props if props is None or p in set(props)]) for t in self.edge_tables(types)]
        if not frames:
            return self.spark.createDataFrame([], f"`{ID}` long, `{SRC}` long, `{DST}` long, `__type` string")
        return stacked(frames) if len(frames) > 1 else frames[0]

    def next_id(self) -> int:
        """An id above every id in use; kept in ``meta`` where it is known."""
        if "next_id" in self.meta:
            return self.meta["next_id"]
        tops = [t.df.agg(F.max(ID)).first()[0] for t in (*self.nodes, *self.edges)]
        return max([x for x in tops if x is not None], default=-1) + 1

    @staticmethod
    def build(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> PropertyGraph:
        """A small graph from Python values: nodes {id, labels, **props}, edges {src, dst, type, **props}."""
        def frame(rows: list[dict], fixed: list[str]) -> DataFrame:
            keys = list(dict.fromkeys(k for r in rows for k in r))
            kinds: dict[str, T.DataType] = {}
            for k in keys:
                kind: T.DataType = T.NullType()
                for r in rows:
                    kind = widened(kind, _kind(r.get(k)))
                kinds[k] = T.LongType() if k in fixed else T.StringType() if isinstance(kind, T.NullType) else kind
            schema = T.StructType([T.StructField(k, kinds[k]) for k in keys])
            return spark.createDataFrame([tuple(_fit(r.get(k), kinds[k]) for k in keys) for r in rows], schema)

        by_labels: dict[frozenset, list[dict]] = {}
        for n in nodes:
            by_labels.setdefault(frozenset(n.get("labels", [])), []).append({ID: n["id"]} | {k: v for k, v in n.items() if k not in ("id", "labels")})
        by_type: dict[str, list[dict]] = {}
        for k, e in enumerate(edges):
            by_type.setdefault(e["type"], []).append({ID: e.get("id", k), SRC: e["src"], DST: e["dst"]} | {a: v for a, v in e.items() if a not in ("id", "src", "dst", "type")})
        top = max([-1, *(n["id"] for n in nodes), *(e.get("id", k) for k, e in enumerate(edges))]) + 1
        meta = {"next_id": top}
        return PropertyGraph(spark, tuple(NodeTable(ls, frame(r, [ID])) for ls, r in by_labels.items()), tuple(EdgeTable(t, frame(r, [ID, SRC, DST])) for t, r in by_type.items()), meta)


def _kind(value: Any) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, (list, tuple)):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = widened(kind, _kind(v))
        return T.ArrayType(T.StringType() if isinstance(kind, T.NullType) else kind)
    if hasattr(value, "year"):
        return T.TimestampType()
    return T.StringType()


def _fit(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    return value
