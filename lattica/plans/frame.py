"""Rows of a query in progress: a DataFrame and what its variables stand for."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import DST, ID, SRC

_numbers = itertools.count()


def fresh(hint: str = "c") -> str:
    """A column name no other variable has; names never clash, so joins need no aliases."""
    return f"_{hint}{next(_numbers)}"


@dataclass
class Node:
    id: str
    labels: str | None = None
    props: dict[str, str] = field(default_factory=dict)
    known: frozenset[str] = frozenset()

    def columns(self) -> list[str]:
        return [self.id, *([self.labels] if self.labels else []), *self.props.values()]

    def whole(self) -> Column:
        parts = [F.col(self.id).alias(ID), (F.col(self.labels) if self.labels else F.array(*[F.lit(x) for x in sorted(self.known)]).cast("array<string>")).alias("__labels")]
        return F.when(F.col(self.id).isNotNull(), F.struct(*parts, *[F.col(c).alias(p) for p, c in sorted(self.props.items())]))


@dataclass
class Edge:
    id: str
    src: str
    dst: str
    type: str
    props: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.id, self.src, self.dst, self.type, *self.props.values()]

    def whole(self) -> Column:
        parts = [F.col(getattr(self, a)).alias(b) for a, b in (("id", ID), ("src", SRC), ("dst", DST), ("type", "__type"))]
        return F.when(F.col(self.id).isNotNull(), F.struct(*parts, *[F.col(c).alias(p) for p, c in sorted(self.props.items())]))


@dataclass
class PathOf:
    """A path: ids along it, and the entities themselves where its length is fixed."""

    nodes: str
    rels: str
    parts: list[Any] = field(default_factory=list)

    def columns(self) -> list[str]:
        return [self.nodes, self.rels, *[c for p in self.parts for c in p.columns()]]

    def whole(self) -> Column:
        return F.when(F.col(self.rels).isNotNull(), F.struct(F.col(self.nodes).alias("nodes"), F.col(self.rels).alias("rels")))


@dataclass
class Scalar:
    col: str

    def columns(self) -> list[str]:
        return [self.col]

    def whole(self) -> Column:
        return F.col(self.col)


Binding = Node | Edge | PathOf | Scalar


def key_of(b: Binding) -> str:
    """The column that identifies a binding."""
    return b.id if isinstance(b, (Node, Edge)) else b.rels if isinstance(b, PathOf) else b.col


@dataclass
class Frame:
    df: DataFrame
    vars: dict[str, Binding] = field(default_factory=dict)
    single: bool = False  # one row without columns

    _probe: DataFrame | None = None

    def probe(self, c: Column) -> T.DataType:
        """The type of an expression over this frame, from its schema alone."""
        if self._probe is None or self._probe.schema != self.df.schema:
            self._probe = self.df.sparkSession.createDataFrame([], self.df.schema)
        return self._probe.select(c.alias("x")).schema[0].dataType

    def having(self, df: DataFrame, **new: Binding) -> Frame:
        return Frame(df, self.vars | new)


def entity(kind: T.DataType) -> str:
    """'node', 'edge' or '' for the type of a value."""
    if isinstance(kind, T.StructType):
        names = {f.name for f in kind.fields}
        if ID in names:
            return "edge" if SRC in names else "node"
    return ""
