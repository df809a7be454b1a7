"""Syntax trees of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class CypherError(ValueError):
    """A query that is refused; ``kind`` names the rule it breaks."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


class Expr:
    """Base of expressions."""


@dataclass(eq=False)
class Lit(Expr):
    value: Any


@dataclass(eq=False)
class Param(Expr):
    name: str


@dataclass(eq=False)
class Var(Expr):
    name: str


@dataclass(eq=False)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(eq=False)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(eq=False)
class Slice(Expr):
    of: Expr
    low: Expr | None
    high: Expr | None


@dataclass(eq=False)
class ListLit(Expr):
    items: list[Expr]


@dataclass(eq=False)
class MapLit(Expr):
    items: list[tuple[str, Expr]]


@dataclass(eq=False)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(eq=False)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(eq=False)
class HasLabels(Expr):
    of: Expr
    labels: list[str]


@dataclass(eq=False)
class Func(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass(eq=False)
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    other: Expr | None


@dataclass(eq=False)
class ListComp(Expr):
    var: str
    source: Expr
    where: Expr | None
    to: Expr | None


@dataclass(eq=False)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(eq=False)
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    step: Expr


@dataclass(eq=False)
class NodePat:
    var: str | None
    labels: list[str]
    props: Expr | None = None


@dataclass(eq=False)
class RelPat:
    var: str | None
    types: list[str]
    direction: str  # out, in, both
    props: Expr | None = None
    span: tuple[int, int | None] | None = None  # of a variable length


@dataclass(eq=False)
class Path:
    var: str | None
    nodes: list[NodePat]
    rels: list[RelPat]
    kind: str = ""  # shortest, all


@dataclass(eq=False)
class Exists(Expr):
    paths: list[Path]
    where: Expr | None


@dataclass(eq=False)
class PatternComp(Expr):
    path: Path
    where: Expr | None
    to: Expr


class Clause:
    """Base of clauses."""

    writes = False


@dataclass(eq=False)
class Match(Clause):
    paths: list[Path]
    where: Expr | None
    optional: bool = False


@dataclass(eq=False)
class Unwind(Clause):
    source: Expr
    var: str


@dataclass(eq=False)
class Item:
    expr: Expr
    alias: str | None
    text: str

    @property
    def name(self) -> str:
        return self.alias or self.text


@dataclass(eq=False)
class Project(Clause):
    """WITH and RETURN."""

    items: list[Item]
    star: bool
    distinct: bool
    order: list[tuple[Expr, bool]]
    skip: Expr | None
    limit: Expr | None
    where: Expr | None
    final: bool


@dataclass(eq=False)
class Create(Clause):
    paths: list[Path]
    writes = True


@dataclass(eq=False)
class Merge(Clause):
    path: Path
    on_create: list[SetItem]
    on_match: list[SetItem]
    writes = True


@dataclass(eq=False)
class SetItem:
    var: str
    kind: str  # prop, replace, merge, labels, drop_prop, drop_labels
    key: str | None = None
    value: Expr | None = None
    labels: list[str] = field(default_factory=list)


@dataclass(eq=False)
class SetClause(Clause):
    items: list[SetItem]
    writes = True


@dataclass(eq=False)
class Delete(Clause):
    exprs: list[Expr]
    detach: bool
    writes = True


@dataclass(eq=False)
class Foreach(Clause):
    var: str
    source: Expr
    body: list[Clause]
    writes = True


@dataclass(eq=False)
class CallProc(Clause):
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]] | None
    where: Expr | None = None


@dataclass(eq=False)
class CallQuery(Clause):
    query: Query


@dataclass(eq=False)
class Command(Clause):
    """Definitions and SHOW."""

    kind: str
    args: dict[str, Any]
    writes = True


@dataclass(eq=False)
class Query:
    """Branches of ordered clauses, joined by UNION."""

    branches: list[list[Clause]]
    union_all: bool = False
    mode: str = ""  # explain, profile

    @property
    def writes(self) -> bool:
        return any(c.writes and not (isinstance(c, Command) and c.kind.startswith("show")) for b in self.branches for c in b)


def children(x: Any) -> list[Any]:
    """Direct parts of an expression or pattern."""
    out: list[Any] = []
    for value in vars(x).values() if hasattr(x, "__dict__") else []:
        stack = [value]
        while stack:
            v = stack.pop(0)
            if isinstance(v, (list, tuple)):
                stack = [*v, *stack]
            elif isinstance(v, (Expr, NodePat, RelPat, Path, Item, SetItem, Clause, Query)):
                out.append(v)
    return out


def walk(x: Any):
    """Every part of a tree, itself first."""
    yield x
    for c in children(x):
        yield from walk(c)
