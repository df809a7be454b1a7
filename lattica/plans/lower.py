"""From syntax trees to DataFrames: patterns become joins, clauses become projections and aggregations.

Nothing is executed here but loops of unknown length (see operators.traversal) and writes.
"""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import aggregates
from lattica.model import DST, ID, SRC, PropertyGraph, checkpointed
from lattica.operators import hierarchy, traversal
from lattica.plans.ast import (
    Binary, CallProc, CallQuery, Clause, Command, Create, CypherError, Delete, Exists, Expr, Foreach, Func, HasLabels, Index, IsNull, Item, Lit, MapLit, Match, Merge, NodePat, Param, Path, PatternComp, Project, Prop,
    Query, RelPat, SetClause, Unwind, Var, children, walk,
)
from lattica.plans.expressions import Expressions, ends_of, free_vars, has_aggregate, is_aggregate
from lattica.plans.frame import Edge, Frame, Node, PathOf, Scalar, entity, fresh, key_of

#: Functions that need only the identity of an entity.
BY_ID = {"id", "elementid", "labels", "type", "count", "startnode", "endnode", "exists", "subsumes", "hierarchy_lca", "hierarchy_rollup", "length", "nodes", "relationships"}


#: How many bytes of file the rows of one block of a join of many to many stand for (left x right / nodes); some millions of rows.
BLOCK_BYTES = 1 << 24
#: A table of nodes up to this size has fewer nodes than a join needs keys to spread.
FEW_BYTES = 1 << 15


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "AND" else [e]


def needed(query: Query) -> tuple[set[str] | None, bool]:
    """(property names that a query reads, or None for all; whether it reads labels)."""
    keys: set[str] = set()
    whole, labels = False, False
    passed: set[int] = set()
    nodes = list(walk(query))
    named = {x.var for x in nodes if isinstance(x, (NodePat, RelPat)) and x.var} | {a for x in nodes if isinstance(x, CallProc) for _, a in x.yields or []}
    for x in nodes:
        if isinstance(x, Prop):
            keys.add(x.key)
            passed.add(id(x.of))
        elif isinstance(x, Index):
            if isinstance(x.at, Lit) and isinstance(x.at.value, str):
                keys.add(x.at.value)
                passed.add(id(x.of))
        elif isinstance(x, (NodePat, RelPat)) and isinstance(x.props, MapLit):
            keys |= {k for k, _ in x.props.items}
        elif isinstance(x, (NodePat, RelPat)) and isinstance(x.props, Param):
            whole = True
        elif isinstance(x, Func) and x.name in BY_ID:
            passed |= {id(a) for a in x.args}
            labels |= x.name == "labels"
        elif isinstance(x, Func) and x.name in ("properties", "keys"):
            whole = True
        elif isinstance(x, (IsNull, HasLabels)):
            passed.add(id(x.of))
            labels |= isinstance(x, HasLabels)
        elif isinstance(x, Binary) and x.op in ("=", "<>", "IN"):
            passed |= {id(x.left), id(x.right)}
        elif isinstance(x, Project) and not x.final:
            passed |= {id(i.expr) for i in x.items if isinstance(i.expr, Var)}
        elif isinstance(x, Project) and x.star:
            whole = True
        elif isinstance(x, (SetClause, Merge)):
            whole = labels = True
    whole |= any(isinstance(x, Var) and id(x) not in passed and x.name in named for x in nodes)
    return (None if whole else keys), labels or whole


def size_of(df: DataFrame) -> int:
    """Bytes of the largest table that the rows come from, as the optimizer knows them from its files; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return max((int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())), default=0)


def in_blocks(left: DataFrame, a: str, left_marks: list[str], right: DataFrame, b: str, right_marks: list[str], blocks: int) -> DataFrame:
    """The join on a = b where few keys hold most rows: each side of a key is cut into parts by a hash, and each two parts meet in one of ``blocks`` partitions."""
    parts = math.ceil(math.sqrt(blocks))
    own = lambda marks: F.pmod(F.xxhash64(*marks), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    i, j, k, m = fresh("i"), fresh("j"), fresh("i"), fresh("j")
    one = left.withColumn(i, own(left_marks)).withColumn(j, every).repartition(blocks, a, i, j)
    two = right.withColumn(m, own(right_marks)).withColumn(k, every).repartition(blocks, b, k, m)
    return one.join(two, (F.col(a) == F.col(b)) & (F.col(i) == F.col(k)) & (F.col(j) == F.col(m))).drop(i, j, k, m)


class Lowerer:
    """Lowers one query over a graph. ``writer`` executes clauses that write; without it they are refused."""

    def __init__(self, graph: PropertyGraph, params: dict[str, Any] | None = None, writer: Any = None):
        self.graph, self.params, self.writer = graph, params or {}, writer
        self.keys: set[str] | None = None
        self.want_labels = True
        self.notes: list[str] = []

    @property
    def spark(self) -> SparkSession:
        return self.graph.spark

    # --- queries ---

    def run(self, query: Query) -> DataFrame:
        self.keys, self.want_labels = needed(query)
        return self.query(query)

    def query(self, query: Query) -> DataFrame:
        out: DataFrame | None = None
        for branch in query.branches:
            df = self.branch(branch)
            if out is None:
                out = df
                continue
            if out.columns != df.columns:
                raise CypherError("UnionColumnMismatch", f"{out.columns} and {df.columns}")
            kinds = [T.StructField(a.name, a.dataType if a.dataType == b.dataType else _wide(a.dataType, b.dataType)) for a, b in zip(out.schema, df.schema, strict=True)]
            out, df = (x.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds]) for x in (out, df))
            out = out.union(df)
        return out if query.union_all or len(query.branches) == 1 else out.distinct()

    def branch(self, clauses: list[Clause]) -> DataFrame:
        frame = Frame(self.spark.range(1).select(F.lit(1).alias("_one")), {}, single=True)
        result: DataFrame | None = None
        for k, c in enumerate(clauses):
            if isinstance(c, Project):
                frame = self.project(frame, c)
                if c.final:
                    if k + 1 < len(clauses):
                        raise CypherError("Syntax", "RETURN must come last")
                    result = self.output(frame)
            elif isinstance(c, Match):
                frame = self.optional(frame, c) if c.optional else self.match(frame, c.paths, c.where)
            elif isinstance(c, Unwind):
                frame = self.unwind(frame, c)
            elif isinstance(c, CallProc):
                frame = self.call(frame, c, last=k + 1 == len(clauses))
                if k + 1 == len(clauses):
                    result = self.output(frame)
            elif isinstance(c, CallQuery):
                frame = self.subquery(frame, c)
            elif isinstance(c, Command):
                return self.need_writer(c).command(self, c)
            elif isinstance(c, (Create, Merge, SetClause, Delete, Foreach)):
                frame = self.need_writer(c).clause(self, frame, c)
        if result is None:
            if not any(c.writes for c in clauses):
                raise CypherError("Syntax", "a query that reads must end with RETURN")
            result = self.spark.createDataFrame([], "`rows` long").select()
        return result

    def need_writer(self, c: Clause) -> Any:
        if self.writer is None and not (isinstance(c, Command) and c.kind.startswith("show")):
            raise CypherError("WriteInReadQuery", type(c).__name__)
        if self.writer is None:
            from lattica.operators.writes import Writer

            return Writer()
        return self.writer

    def output(self, frame: Frame) -> DataFrame:
        return frame.df.select(*[b.whole().alias(name) for name, b in frame.vars.items()])

    # --- expressions ---

    def compiler(self, frame: Frame, memo: dict[int, Any] | None = None) -> Expressions:
        return Expressions(frame, self.params, memo or {})

    def prepare(self, frame: Frame, exprs: list[Expr]) -> tuple[Frame, dict[int, Any]]:
        """Lower the parts of expressions that need joins of their own; memo tells where their values are."""
        memo: dict[int, Any] = {}
        for top in exprs:
            for e in self._joined_parts(top):
                if isinstance(e, Exists):
                    frame = self.mark(frame, e, memo)
                elif isinstance(e, PatternComp):
                    frame = self.comprehension(frame, e, memo)
                elif isinstance(e, Func) and e.name in ("startnode", "endnode"):
                    frame = self.end_node(frame, e, memo)
                elif isinstance(e, Func) and e.name in ("nodes", "relationships", "rels"):
                    frame = self.path_parts(frame, e, memo)
                elif isinstance(e, Func):
                    frame = hierarchy.lower(self, frame, e, memo)
        return frame, memo

    def _joined_parts(self, e: Any) -> list[Expr]:
        if isinstance(e, (Exists, PatternComp)):
            return [e]
        own = []
        if isinstance(e, Func) and (e.name in ("startnode", "endnode", "nodes", "relationships", "rels") or e.name in hierarchy.FUNCTIONS):
            own = [e]
        return [x for c in children(e) for x in self._joined_parts(c)] + own

    def outer(self, frame: Frame, names: set[str]) -> Frame:
        """The distinct values of some variables, as rows from which a correlated part is worked out."""
        vars_ = {n: b for n, b in frame.vars.items() if n in names}
        columns = list(dict.fromkeys(c for b in vars_.values() for c in b.columns()))
        if not columns:
            return Frame(self.spark.range(1).select(F.lit(1).alias("_one")), {}, single=True)
        return Frame(frame.df.select(*columns).distinct(), vars_)

    @staticmethod
    def join_back(frame: Frame, right: DataFrame, names: dict[str, Any], how: str) -> DataFrame:
        """Join rows worked out from ``outer`` back, on the identities of its variables (null equals null)."""
        keys = list(dict.fromkeys(key_of(b) for b in names.values()))
        if not keys:
            return frame.df.join(right, F.lit(True), how)
        renamed = right.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in right.columns if c not in keys and c not in frame.df.columns])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}__r"))
        return frame.df.join(renamed, on, how).drop(*[f"{k}__r" for k in keys])

    def mark(self, frame: Frame, e: Exists, memo: dict[int, Any]) -> Frame:
        inner = self.outer(frame, free_vars(e))
        hit = self.match(inner, e.paths, e.where)
        name = fresh("exists")
        right = hit.df.select(*[key_of(b) for b in inner.vars.values()]).distinct().withColumn(name, F.lit(True))
        df = self.join_back(frame, right, inner.vars, "left").withColumn(name, F.coalesce(name, F.lit(False)))
        memo[id(e)] = name
        return frame.having(df)

    def semi(self, frame: Frame, e: Exists, negated: bool) -> Frame:
        """An EXISTS that stands alone as a condition: a semi or an anti join."""
        inner = self.outer(frame, free_vars(e))
        hit = self.match(inner, e.paths, e.where)
        right = hit.df.select(*[key_of(b) for b in inner.vars.values()])
        return frame.having(self.join_back(frame, right, inner.vars, "left_anti" if negated else "left_semi"))

    def comprehension(self, frame: Frame, e: PatternComp, memo: dict[int, Any]) -> Frame:
        inner = self.outer(frame, free_vars(e))
        hit = self.match(inner, [e.path], e.where)
        hit, own = self.prepare(hit, [e.to])
        value, kind = self.compiler(hit, own).typed(e.to)
        name = fresh("list")
        keys = [key_of(b) for b in inner.vars.values()]
        listed = hit.df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))
        df = self.join_back(frame, listed, inner.vars, "left")
        df = df.withColumn(name, F.coalesce(name, F.array().cast(T.ArrayType(kind))))
        memo[id(e)] = name
        return frame.having(df)

    def end_node(self, frame: Frame, e: Func, memo: dict[int, Any]) -> Frame:
        b = self.compiler(frame, memo).binding(e.args[0])
        if not isinstance(b, Edge):
            raise CypherError("TypeError", f"{e.name} of something that is no relationship")
        node, nodes = self.nodes_as(())
        df = frame.df.join(nodes, F.col(ends_of(b, e.name)) == F.col(node.id), "left")
        memo[id(e)] = node
        return frame.having(df)

    def path_parts(self, frame: Frame, e: Func, memo: dict[int, Any]) -> Frame:
        """Entities along a path of variable length: ids are looked up and put together again in order."""
        b = self.compiler(frame, memo).binding(e.args[0])
        if not isinstance(b, PathOf) or b.parts:
            return frame
        ids, name, at = (b.nodes if e.name == "nodes" else b.rels), fresh("parts"), fresh("at")
        whole = Frame(frame.df).df.select(ids).distinct()
        flat = whole.select(ids, F.posexplode(ids).alias(at, "__x"))
        if e.name == "nodes":
            node, table = self.nodes_as(())
            joined = flat.join(table, F.col("__x") == F.col(node.id))
            value = node.whole()
        else:
            edge, table = self.edges_as((), None)
            joined = flat.join(table, F.col("__x") == F.col(edge.id))
            value = edge.whole()
        listed = joined.groupBy(ids).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), value.alias("x")))), lambda s: s["x"]).alias(name))
        listed = listed.withColumnRenamed(ids, f"{ids}__r")
        df = frame.df.join(listed, F.col(ids) == F.col(f"{ids}__r"), "left").drop(f"{ids}__r")
        memo[id(e)] = name
        return frame.having(df)

    # --- tables as bindings ---

    def nodes_as(self, labels: Any, props: set[str] | None = None, known: Any = ()) -> tuple[Node, DataFrame]:
        df = self.graph.scan(labels, self.keys if props is None else props)
        node = Node(fresh("n"), fresh("l"), {c: fresh("p") for c in df.columns if c not in (ID, "__labels")}, frozenset(labels))
        return node, df.select(F.col(ID).alias(node.id), F.col("__labels").alias(node.labels), *[F.col(f"`{p}`").alias(c) for p, c in node.props.items()])

    def edges_as(self, types: Any, tables: Any = None) -> tuple[Edge, DataFrame]:
        graph = self.graph if tables is None else self.graph.with_edges(tables)
        df = graph.scan_edges(types, self.keys)
        edge = Edge(fresh("e"), fresh("s"), fresh("d"), fresh("t"), {c: fresh("p") for c in df.columns if c not in (ID, SRC, DST, "__type")})
        return edge, df.select(*[F.col(a).alias(getattr(edge, b)) for a, b in ((ID, "id"), (SRC, "src"), (DST, "dst"), ("__type", "type"))], *[F.col(f"`{p}`").alias(c) for p, c in edge.props.items()])

    # --- MATCH ---

    def match(self, frame: Frame, paths: list[Path], where: Expr | None) -> Frame:
        waiting = conjuncts(where)
        used: list[Edge] = []
        left = list(paths)
        while left:
            bound = [p for p in left if any(n.var in frame.vars for n in p.nodes if n.var) or any(r.var in frame.vars for r in p.rels if r.var)]
            path = (bound or left)[0]
            left.remove(path)
            frame, waiting = self.path(frame, path, waiting, used)
        return self.where(frame, waiting)

    def where(self, frame: Frame, parts: list[Expr]) -> Frame:
        plain = [p for p in parts if not self._alone(p)]
        frame = self.filter(frame, plain)
        for p in parts:
            if self._alone(p):
                negated = not isinstance(p, Exists)
                e = p.of if negated else p
                frame = self.semi(frame, e if isinstance(e, Exists) else e.args[0], negated)
        return frame

    @staticmethod
    def _alone(p: Expr) -> bool:
        return isinstance(p, Exists) or (getattr(p, "op", "") == "NOT" and isinstance(p.of, Exists))

    def filter(self, frame: Frame, parts: list[Expr]) -> Frame:
        if not parts:
            return frame
        columns = frame.df.columns
        frame, memo = self.prepare(frame, parts)
        for p in parts:
            if has_aggregate(p):
                raise CypherError("InvalidAggregation", "an aggregate in WHERE")
            frame = frame.having(frame.df.where(self.compiler(frame, memo).boolean(p)))
        return frame.having(frame.df.select(*columns)) if memo else frame

    def ready(self, frame: Frame, waiting: list[Expr]) -> tuple[Frame, list[Expr]]:
        """Apply the conditions whose variables are all there."""
        now = [p for p in waiting if not any(isinstance(x, (Exists, PatternComp)) for x in walk(p)) and free_vars(p) <= set(frame.vars)]
        return self.filter(frame, now), [p for p in waiting if p not in now]

    def anchor(self, frame: Frame, path: Path, waiting: list[Expr]) -> int:
        """Where to start: at a bound variable, else where conditions are, else at the rarest labels."""
        equal = {x.of.name for p in waiting if isinstance(p, Binary) and p.op in ("=", "IN") for x in (p.left, p.right) if isinstance(x, Prop) and isinstance(x.of, Var)}
        equal |= {x.args[0].name for p in waiting if isinstance(p, Binary) and p.op in ("=", "IN") for x in (p.left, p.right) if isinstance(x, Func) and x.name == "id" and isinstance(x.args[0], Var)}

        def rank(k: int) -> tuple:
            n = path.nodes[k]
            return (0 if n.var in frame.vars else 1 if n.props is not None or n.var in equal else 2 if n.labels else 3, len(self.graph.node_tables(n.labels)), k)

        return min(range(len(path.nodes)), key=rank)

    def circle(self, frame: Frame, path: Path, names: list[str], rels: list[str], waiting: list[Expr]) -> list[int]:
        """The order of hops of a path that meets itself: from the relationship after which the fewest hops multiply rows. Empty where that is not to choose.

        A hop to a node that is there already only drops rows, and so does one that finds a single relationship at most;
        these come first. Conditions that pin a node decide between orders that are as good.
        """
        if len(set(names)) == len(names) or set(names + rels) & set(frame.vars) or any(r.span is not None for r in path.rels):
            return []
        if any(free_vars(x.props) for x in (*path.nodes, *path.rels) if x.props is not None):
            return []
        known: dict[str, frozenset] = {}
        for n, pat in zip(names, path.nodes, strict=True):
            known[n] = known.get(n, frozenset()) | frozenset(pat.labels)

        def multiplies(k: int, forward: bool) -> bool:
            rel, direction = path.rels[k], self.turned(path.rels[k], forward)
            a, b = (names[k], names[k + 1]) if forward else (names[k + 1], names[k])
            tables = [t for t in self.graph.edge_tables(rel.types) if self._fits(t, direction, known[a], known[b])]
            return len(tables) != 1 or direction not in tables[0].single

        def grown(first: int) -> tuple[int, list[int]]:
            low, high, order, cost = first, first + 1, [first], 0
            there = {names[first], names[first + 1]}
            while len(order) < len(path.rels):
                sides = ([(high, True, names[high + 1])] if high < len(path.rels) else []) + ([(low - 1, False, names[low - 1])] if low else [])
                price, (k, forward, name) = min(((0 if n not in there and not multiplies(k, f) else -1 if n in there else 1), (k, f, n)) for k, f, n in sides)
                cost += max(price, 0)
                order.append(k)
                there.add(name)
                low, high = (low, high + 1) if forward else (low - 1, high)
            return cost, order

        anchor = self.anchor(frame, path, waiting)
        return min((grown(k) for k in range(len(path.rels))), key=lambda g: (g[0], anchor not in (g[1][0], g[1][0] + 1), g[1][0]))[1]

    def pinned(self, name: str, waiting: list[Expr]) -> PropertyGraph:
        """The graph with its node tables cut to the ids that a condition names for a variable, by their source keys, which scans can push down."""
        ids: set[int] | None = None
        for p in waiting:
            if isinstance(p, Binary) and p.op in ("=", "IN"):
                for x, y in ((p.left, p.right), (p.right, p.left)) if p.op == "=" else ((p.left, p.right),):
                    if isinstance(x, Func) and x.name == "id" and isinstance(x.args[0], Var) and x.args[0].name == name:
                        try:
                            value = self.constant(y)
                        except CypherError:
                            continue
                        own = {v for v in (value if isinstance(value, list) else [value]) if isinstance(v, int)}
                        ids = own if ids is None else ids & own
        return self.graph if ids is None else self.graph.with_nodes(t.of_ids(ids) for t in self.graph.nodes)

    def path(self, frame: Frame, path: Path, waiting: list[Expr], used: list[Edge]) -> tuple[Frame, list[Expr]]:
        names = [n.var or fresh("anon") for n in path.nodes]
        rels = [r.var or fresh("rel") for r in path.rels]
        if path.kind:
            return self.shortest(frame, path, names, waiting)
        start = self.anchor(frame, path, waiting)
        order = [*range(start, len(path.rels)), *range(start - 1, -1, -1)]
        pieces: dict[int, Any] = {}
        circle = self.circle(frame, path, names, rels, waiting)
        if circle:
            start, order = circle[0], circle
        if circle or order and names[start] not in frame.vars and path.nodes[start].props is None and path.rels[order[0]].span is None and rels[order[0]] not in frame.vars:
            frame, waiting = self.first_hop(frame, path, names, rels, start, order.pop(0), waiting, used)
        else:
            whole, self.graph = self.graph, self.pinned(names[start], waiting)
            frame = self.place(frame, names[start], path.nodes[start])
            self.graph = whole
        frame, waiting = self.ready(frame, waiting)
        for k in order:
            forward = k >= start
            a, b = (k, k + 1) if forward else (k + 1, k)
            rel = path.rels[k]
            if rel.span is None:
                frame = self.hop(frame, names[a], rel, rels[k], self.turned(rel, forward), names[b], path.nodes[b], used)
            else:
                frame, pieces[k] = self.reach(frame, names[a], rel, rels[k], self.turned(rel, forward), names[b], path.nodes[b], path.var is not None, forward)
            frame, waiting = self.ready(frame, waiting)
        if path.var:
            if path.var in frame.vars:
                raise CypherError("VariableTypeConflict", path.var)
            frame = self.named(frame, path, names, rels, pieces)
        return frame, waiting

    def named(self, frame: Frame, path: Path, names: list[str], rels: list[str], pieces: dict[int, Any]) -> Frame:
        """Bind the variable of a path."""
        b = PathOf(fresh("nodes"), fresh("rels"))
        nodes, edges = F.array(F.col(frame.vars[names[0]].id)), F.array().cast("array<bigint>")
        for k in range(len(path.rels)):
            if k in pieces:
                along, over = pieces[k]
                nodes = F.concat(nodes, F.slice(F.col(along), F.lit(2), F.greatest(F.size(along) - 1, F.lit(0))))
                edges = F.concat(edges, F.col(over))
            else:
                nodes = F.concat(nodes, F.array(F.col(frame.vars[names[k + 1]].id)))
                edges = F.concat(edges, F.array(F.col(frame.vars[rels[k]].id)))
        if not pieces:
            b.parts = [frame.vars[x] for pair in zip(names, [*rels, None], strict=True) for x in pair if x is not None]
        return frame.having(frame.df.withColumn(b.nodes, nodes).withColumn(b.rels, edges), **{path.var: b})

    def place(self, frame: Frame, name: str, pat: NodePat) -> Frame:
        """Bring a node into the frame: check it if it is bound, else scan."""
        if name in frame.vars:
            frame = self.as_node(frame, name)
            return self.check(frame, name, pat)
        node, df = self.nodes_as(pat.labels)
        joined = Frame(df, {name: node}) if frame.single and not frame.vars else frame.having(frame.df.crossJoin(df), **{name: node})
        return self.inline(joined, node, pat.props)

    def as_node(self, frame: Frame, name: str) -> Frame:
        """A value that is a node (out of a list, say) as a binding."""
        b = frame.vars[name]
        if isinstance(b, Node):
            return frame
        kind = frame.probe(b.whole())
        if isinstance(b, Scalar) and entity(kind) == "node":
            node = Node(fresh("n"), fresh("l"), {f.name: fresh("p") for f in kind.fields if f.name not in (ID, "__labels")})
            c = F.col(b.col)
            df = frame.df.withColumns({node.id: c[ID], node.labels: c["__labels"]} | {col: c[p] for p, col in node.props.items()})
            return frame.having(df, **{name: node})
        raise CypherError("VariableTypeConflict", f"{name} is no node")

    def check(self, frame: Frame, name: str, pat: NodePat) -> Frame:
        if pat.labels:
            frame = frame.having(frame.df.where(self.compiler(frame).column(HasLabels(Var(name), pat.labels))))
        return self.inline(frame, frame.vars[name], pat.props)

    def inline(self, frame: Frame, b: Node | Edge, props: Expr | None) -> Frame:
        """The conditions of a property map in a pattern."""
        if props is None:
            return frame
        items = props.items if isinstance(props, MapLit) else [(k, Lit(v)) for k, v in self.params.get(props.name, {}).items()] if isinstance(props, Param) else None
        if items is None:
            raise CypherError("Syntax", "a pattern's properties must be a map")
        for key, value in items:
            c, kind = self.compiler(frame).typed(value)
            have = F.col(b.props[key]) if key in b.props else F.lit(None)
            frame = frame.having(frame.df.where(self.compiler(frame).compare("=", have, frame.probe(have), c, kind)))
        return frame

    @staticmethod
    def turned(rel: RelPat, forward: bool) -> str:
        return rel.direction if forward else {"out": "in", "in": "out", "both": "both"}[rel.direction]

    def edge_rows(self, rel: RelPat, direction: str, known_a: frozenset, known_b: frozenset) -> tuple[Edge, DataFrame, str, str, list, set, set]:
        """Relationships as rows: binding, rows, near and far column, tables, and the labels that either end may carry."""
        tables = [t for t in self.graph.edge_tables(rel.types) if self._fits(t, direction, known_a, known_b)]
        edge, df = self.edges_as((), tables) if tables else self.edges_as(("\0none",))
        src, dst = {t.src_label for t in tables}, {t.dst_label for t in tables}
        if direction != "both":
            return (edge, df, edge.src, edge.dst, tables, src, dst) if direction == "out" else (edge, df, edge.dst, edge.src, tables, dst, src)
        at, to = fresh("a"), fresh("b")
        flip = df.where(F.col(edge.src) != F.col(edge.dst)).withColumn(at, F.col(edge.dst)).withColumn(to, F.col(edge.src))
        return edge, df.withColumn(at, F.col(edge.src)).withColumn(to, F.col(edge.dst)).unionByName(flip), at, to, tables, src | dst, src | dst

    def unique(self, frame: Frame, edge: Edge, rel: RelPat, tables: list, used: list) -> Frame:
        """A relationship is used once within one MATCH."""
        for other, types in used:
            if not types or not rel.types or set(types) & set(rel.types):
                # ends too: ids that are hashes may meet, but hardly between the same ends
                same = (F.col(other.id) == F.col(edge.id)) & (F.col(other.src) == F.col(edge.src)) & (F.col(other.dst) == F.col(edge.dst))
                if len(tables) > 1 or not types or set(types) != set(rel.types):
                    same = same & (F.col(other.type) == F.col(edge.type))
                frame = frame.having(frame.df.where(~same))
        used.append((edge, rel.types))
        return frame

    def first_hop(self, frame: Frame, path: Path, names: list[str], rels: list[str], start: int, k: int, waiting: list[Expr], used: list) -> tuple[Frame, list[Expr]]:
        """Start from the relationships themselves: a node table joins only if something of it is read."""
        forward = k >= start
        a, b = (k, k + 1) if forward else (k + 1, k)
        rel, pat_a, pat_b = path.rels[k], path.nodes[a], path.nodes[b]
        edge, df, at, to, tables, ends_a, ends_b = self.edge_rows(rel, self.turned(rel, forward), frozenset(pat_a.labels), frozenset(pat_b.labels))
        out = Frame(df, {rels[k]: edge}) if frame.single and not frame.vars else frame.having(frame.df.crossJoin(df), **{rels[k]: edge})
        out = self.unique(self.inline(out, edge, rel.props), edge, rel, tables, used)
        out = self.target(out, at, names[a], pat_a, ends_a)
        if names[b] in out.vars:
            out = self.as_node(out, names[b])
            out = out.having(out.df.where(F.col(out.vars[names[b]].id) == F.col(to)))
            return self.check(out, names[b], pat_b), waiting
        out, waiting = self.ready(out, waiting)
        return self.target(out, to, names[b], pat_b, ends_b), waiting

    def hop(self, frame: Frame, a: str, rel: RelPat, rel_name: str, direction: str, b: str, pat: NodePat, used: list) -> Frame:
        """One relationship from the bound node a to b."""
        here = frame.vars[a]
        known_b = frame.vars[b].known if b in frame.vars and isinstance(frame.vars[b], Node) else frozenset(pat.labels)
        edge, df, at, to, tables, _, ends = self.edge_rows(rel, direction, here.known if isinstance(here, Node) else frozenset(), known_b)
        on = F.col(here.id) == F.col(at)
        bound = b in frame.vars
        if bound:
            frame = self.as_node(frame, b)
            on = on & (F.col(frame.vars[b].id) == F.col(to))
        if rel_name in frame.vars:
            old = frame.vars[rel_name]
            old_id = F.col(old.id) if isinstance(old, Edge) else F.col(old.col)[ID]
            on = on & (old_id == F.col(edge.id))
        if not bound and rel_name not in frame.vars and isinstance(here, Node):
            blocks = self.blocks(frame, here, df, tables, direction)
            if blocks > 1:  # what is read of the far end comes before rows multiply, not after
                far = self.target(self.inline(Frame(df, {rel_name: edge}), edge, rel.props), to, b, pat, ends)
                marks = [key_of(x) for x in frame.vars.values()]
                frame = frame.having(in_blocks(frame.df, here.id, marks, far.df, at, [edge.src, edge.dst], blocks), **far.vars)
                return self.unique(frame, edge, rel, tables, used)
        frame = frame.having(frame.df.join(df, on), **{rel_name: edge})
        frame = self.unique(self.inline(frame, edge, rel.props), edge, rel, tables, used)
        return self.check(frame, b, pat) if bound else self.target(frame, to, b, pat, ends)

    def blocks(self, frame: Frame, here: Node, df: DataFrame, tables: list, direction: str) -> int:
        """In how many blocks to join where many rows meet many relationships at few nodes; 1 is a plain join.

        By the sizes of files: rows multiply to about left x right / nodes.
        """
        if len(here.known) != 1 or not frame.vars or any(direction in t.single for t in tables):
            return 1
        few = sum(size_of(t.df) for t in self.graph.node_tables(here.known))
        left, right = size_of(frame.df), size_of(df)
        if not 0 < few <= FEW_BYTES or min(left, right) < 2 * few:
            return 1
        return math.ceil(left * right / few / BLOCK_BYTES)

    @staticmethod
    def _fits(t: Any, direction: str, known_a: frozenset, known_b: frozenset) -> bool:
        """Whether a relationship table can join nodes of these labels at all."""
        def ok(label: str | None, known: frozenset) -> bool:
            return label is None or not known or label in known

        forward, backward = ok(t.src_label, known_a) and ok(t.dst_label, known_b), ok(t.dst_label, known_a) and ok(t.src_label, known_b)
        return forward if direction == "out" else backward if direction == "in" else forward or backward

    def target(self, frame: Frame, column: str, name: str, pat: NodePat, ends: set[str | None]) -> Frame:
        """Bind the node whose id stands in ``column``; its table is joined only for labels and properties that are read."""
        sure = len(ends) == 1 and None not in ends
        labels = list(pat.labels) or (list(ends) if sure else [])
        some = [t for t in self.graph.node_tables(pat.labels) if None in ends or t.labels & ends]
        wanted = {p for t in some for p in t.props} if self.keys is None else {p for p in self.keys if any(p in t.props for t in some)} if self.keys else set()
        enough = bool(ends) and None not in ends and all(t.labels & ends and set(pat.labels) <= t.labels for t in some) and all(any(t.labels == {e} for t in some) or not set(pat.labels) <= {e} for e in ends)
        enough = enough and all(set(pat.labels) <= {e} for e in ends) and (sure or not self.want_labels)
        if enough and (not wanted or name.startswith("_anon")) and pat.props is None:
            node = Node(column, None, {}, frozenset(ends) if sure else frozenset())
            return frame.having(frame.df, **{name: node})
        whole, self.graph = self.graph, self.graph.with_nodes(some)
        node, nodes = self.nodes_as(labels)
        self.graph = whole
        frame = frame.having(frame.df.join(nodes, F.col(column) == F.col(node.id)), **{name: replace(node, known=frozenset(labels))})
        return self.inline(frame, node, pat.props)

    def reach(self, frame: Frame, a: str, rel: RelPat, rel_name: str, direction: str, b: str, pat: NodePat, trace: bool, forward: bool) -> tuple[Frame, Any]:
        """A relationship of variable length: nodes within the bounds, once per start."""
        here = frame.vars[a]
        edges = self.graph.scan_edges(rel.types, None)
        if isinstance(rel.props, MapLit):
            for key, value in rel.props.items:
                c, kind = self.compiler(frame).typed(value)
                have = F.col(f"`{key}`") if key in edges.columns else F.lit(None)
                edges = edges.where(self.compiler(frame).compare("=", have, edges.schema[key].dataType if key in edges.columns else T.NullType(), c, kind))
        trace = trace or not rel_name.startswith("_rel")
        low, high = rel.span
        got = traversal.reach(frame.df.select(F.col(here.id).alias("s")), edges, direction, low, high, trace)
        s, n, nodes, rels = fresh("s"), fresh("n"), fresh("nodes"), fresh("rels")
        turn = (lambda c: F.col(c)) if forward else (lambda c: F.reverse(c))
        got = got.select(F.col("s").alias(s), F.col("n").alias(n), *([turn("nodes").alias(nodes), turn("rels").alias(rels)] if trace else []))
        on = F.col(here.id) == F.col(s)
        bound = b in frame.vars
        if bound:
            frame = self.as_node(frame, b)
            on = on & (F.col(frame.vars[b].id) == F.col(n))
        new: dict[str, Any] = {}
        if not rel_name.startswith("_rel"):
            new[rel_name] = PathOf(nodes, rels)
        frame = frame.having(frame.df.join(got, on))
        if new:  # the variable of such a relationship is the list of relationships
            name = fresh("relist")
            frame, memo = self.prepare(frame.having(frame.df, **new), [f := Func("relationships", [Var(rel_name)])])
            frame = frame.having(frame.df.withColumn(name, F.coalesce(F.col(memo[id(f)]), F.array().cast(frame.probe(F.col(memo[id(f)]))))), **{rel_name: Scalar(name)})
        frame = self.check(frame, b, pat) if bound else self.target(frame, n, b, pat, {None})
        return frame, (nodes, rels)

    def shortest(self, frame: Frame, path: Path, names: list[str], waiting: list[Expr]) -> tuple[Frame, list[Expr]]:
        if len(path.rels) != 1:
            raise CypherError("Syntax", "a shortest path needs exactly one relationship")
        for name, pat in zip(names, path.nodes, strict=True):
            frame = self.place(frame, name, pat)
        frame, waiting = self.ready(frame, waiting)
        rel = path.rels[0]
        low, high = rel.span if rel.span is not None else (1, 1)
        a, b = frame.vars[names[0]], frame.vars[names[1]]
        got = traversal.shortest(frame.df.select(F.col(a.id).alias("s"), F.col(b.id).alias("t")), self.graph.scan_edges(rel.types, []), rel.direction, path.kind == "all", low, high)
        s, t = fresh("s"), fresh("t")
        bind = PathOf(fresh("nodes"), fresh("rels"))
        got = got.select(F.col("s").alias(s), F.col("t").alias(t), F.col("nodes").alias(bind.nodes), F.col("rels").alias(bind.rels))
        frame = frame.having(frame.df.join(got, (F.col(a.id) == F.col(s)) & (F.col(b.id) == F.col(t))).drop(s, t), **({path.var: bind} if path.var else {}))
        if rel.var:
            frame, memo = self.prepare(frame.having(frame.df, **{rel.var: bind}), [f := Func("relationships", [Var(rel.var)])])
            frame = frame.having(frame.df, **{rel.var: Scalar(memo[id(f)])})
        return frame, waiting

    def optional(self, frame: Frame, c: Match) -> Frame:
        """OPTIONAL MATCH: the pattern with its conditions as one side of a left join."""
        names = set().union(*(free_vars(x) for x in ([c.where] if c.where is not None else [])), {x.var for p in c.paths for x in walk(p) if getattr(x, "var", None) and not isinstance(x, Expr)}, *(free_vars(x.props) for p in c.paths for x in (*p.nodes, *p.rels) if x.props is not None))
        inner = self.outer(frame, names)
        for n, b in list(inner.vars.items()):
            if isinstance(b, Scalar) and entity(inner.probe(b.whole())) == "node":
                frame = self.as_node(frame, n)
                inner = self.outer(frame, names)
        hit = self.match(inner, c.paths, c.where)
        new = {n: b for n, b in hit.vars.items() if n not in inner.vars}
        columns = list(dict.fromkeys([*[key_of(b) for b in inner.vars.values()], *[x for b in new.values() for x in b.columns()]]))
        if frame.single and not frame.vars:
            return Frame(frame.df.join(hit.df.select(*columns), F.lit(True), "left"), new)
        copied, moved = hit.df.select(*columns), {}
        for n, b in new.items():  # a column that also stands on the left gets a name of its own
            moved[n] = b
        twice = [x for x in columns if x in frame.df.columns and x not in {key_of(b) for b in inner.vars.values()}]
        if twice:
            names_ = {x: fresh("o") for x in twice}
            copied = copied.withColumnsRenamed(names_)
            moved = {n: _renamed(b, names_) for n, b in new.items()}
        for n, b in moved.items():
            if key_of(b) in {key_of(x) for x in inner.vars.values()}:  # e.g. the far end is the bound id itself
                col = fresh("k")
                copied = copied.withColumn(col, F.col(key_of(b)))
                moved[n] = _renamed(b, {key_of(b): col})
        return frame.having(self.join_back(frame, copied, inner.vars, "left"), **moved)

    # --- rows ---

    def unwind(self, frame: Frame, c: Unwind) -> Frame:
        frame, memo = self.prepare(frame, [c.source])
        value, kind = self.compiler(frame, memo).typed(c.source)
        name = fresh("u")
        if isinstance(kind, T.NullType):
            value = F.array().cast("array<string>")
        elif not isinstance(kind, T.ArrayType):
            value = F.array(value)
        elif isinstance(kind.elementType, T.NullType):
            value = value.cast("array<string>")
        return Frame(frame.df.withColumn(name, F.explode(value)), frame.vars | {c.var: Scalar(name)})

    def subquery(self, frame: Frame, c: CallQuery) -> Frame:
        if c.query.writes:
            raise CypherError("WriteInSubquery", "CALL {} must not write")
        df = self.query(c.query)
        names = {n: fresh("q") for n in df.columns}
        df = df.select(*[F.col(f"`{n}`").alias(x) for n, x in names.items()])
        new: dict[str, Any] = {n: Scalar(x) for n, x in names.items()}
        return Frame(df, new) if frame.single and not frame.vars else frame.having(frame.df.crossJoin(df), **new)

    def call(self, frame: Frame, c: CallProc, last: bool) -> Frame:
        from lattica.operators import procedures

        args = [self.constant(a) for a in c.args]
        df, kinds = procedures.call(self, c.name, args)
        yields = c.yields or [(n, n) for n in df.columns]
        unknown = [f for f, _ in yields if f not in df.columns]
        if unknown:
            raise CypherError("UnknownYield", f"{c.name} yields {df.columns}, not {unknown}")
        names = {f: fresh("y") for f in df.columns}
        df = df.select(*[F.col(f"`{f}`").alias(names[f]) for f in df.columns])
        new: dict[str, Any] = {}
        for f, alias in yields:
            if kinds.get(f) == "node":
                node, nodes = self.nodes_as(())
                df = df.join(nodes, F.col(names[f]) == F.col(node.id))
                new[alias] = node
            else:
                new[alias] = Scalar(names[f])
        out = Frame(df, new) if frame.single and not frame.vars else frame.having(frame.df.crossJoin(df), **new)
        return self.where(out, conjuncts(c.where))

    def constant(self, e: Expr) -> Any:
        """The Python value of an argument that reads no row."""
        if isinstance(e, Lit):
            return e.value
        if isinstance(e, Param):
            if e.name not in self.params:
                raise CypherError("MissingParameter", e.name)
            return self.params[e.name]
        if isinstance(e, MapLit):
            return {k: self.constant(v) for k, v in e.items}
        if hasattr(e, "items"):
            return [self.constant(x) for x in e.items]
        if type(e).__name__ == "Unary" and e.op == "-":
            return -self.constant(e.of)
        raise CypherError("InvalidArgument", "an argument of CALL must be a constant")

    # --- WITH and RETURN ---

    def project(self, frame: Frame, c: Project) -> Frame:
        items = list(c.items)
        if c.star:
            items = [Item(Var(n), None, n) for n in frame.vars if not n.startswith("_")] + items
        if not items:
            raise CypherError("Syntax", "nothing to return")
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise CypherError("DuplicateColumn", ", ".join(n for n in names if names.count(n) > 1))
        grouped = any(has_aggregate(i.expr) for i in items)
        order = [(self._resolved(e, items), up) for e, up in c.order]
        columns = frame.df.columns
        if grouped:
            new = self.aggregate(frame, items)
        else:
            prepared, memo = self.prepare(frame, [i.expr for i in items] + ([e for e, _ in order] if not c.distinct else []))
            new = self.columns(prepared, items, memo)
            if order and not c.distinct:
                both = Frame(new.df, prepared.vars | new.vars)
                keys = [self.compiler(both, memo | {id(i.expr): new.vars[i.name] for i in items}).typed(e) for e, _ in order]
                df = new.df.orderBy(*[_sorted(k, kind, up) for (k, kind), (_, up) in zip(keys, order, strict=True)])
                new = Frame(self.cut(df, c), new.vars)
                return self.finish(new, c)
        keep = list(dict.fromkeys(x for b in new.vars.values() for x in b.columns()))
        df = new.df.select(*keep)
        if c.distinct:
            ids = list(dict.fromkeys(key_of(b) for b in new.vars.values()))
            df = df.distinct() if set(ids) == set(keep) else df.dropDuplicates(ids)
        new = Frame(df, new.vars)
        if order:
            by_text = {i.name: n for i, n in zip(items, names, strict=True)} | {i.text: i.name for i in items}
            memo2: dict[int, Any] = {}
            for e, _ in order:
                self._match_items(e, items, new, memo2)
            keys = []
            for e, _ in order:
                try:
                    keys.append(self.compiler(new, memo2).typed(e))
                except CypherError as problem:
                    raise CypherError("OrderByUndefinedVariable", str(problem)) from None
            del by_text
            new = Frame(new.df.orderBy(*[_sorted(k, kind, up) for (k, kind), (_, up) in zip(keys, order, strict=True)]), new.vars)
        del columns
        new = Frame(self.cut(new.df, c), new.vars)
        return self.finish(new, c)

    def finish(self, frame: Frame, c: Project) -> Frame:
        keep = list(dict.fromkeys(x for b in frame.vars.values() for x in b.columns()))
        out = Frame(frame.df.select(*keep), frame.vars)
        return self.where(out, conjuncts(c.where)) if c.where is not None else out

    def cut(self, df: DataFrame, c: Project) -> DataFrame:
        if c.skip is not None:
            df = df.offset(int(self.constant(c.skip)))
        return df.limit(int(self.constant(c.limit))) if c.limit is not None else df

    @staticmethod
    def _resolved(e: Expr, items: list[Item]) -> Expr:
        """ORDER BY an alias means its expression."""
        return next((i.expr for i in items if isinstance(e, Var) and i.alias == e.name and isinstance(i.expr, Var)), e) if isinstance(e, Var) and not any(i.name == e.name for i in items) else e

    def _match_items(self, e: Any, items: list[Item], frame: Frame, memo: dict[int, Any]) -> None:
        """Parts of an ORDER BY that repeat a projected expression stand for its column."""
        if isinstance(e, Expr):
            for i in items:
                if _same(i.expr, e) and not (isinstance(e, Var) and e.name in frame.vars):
                    memo[id(e)] = frame.vars[i.name]
                    return
        for c in children(e):
            self._match_items(c, items, frame, memo)

    def columns(self, frame: Frame, items: list[Item], memo: dict[int, Any]) -> Frame:
        compiler = self.compiler(frame, memo)
        new: dict[str, Any] = {}
        added: dict[str, Column] = {}
        for i in items:
            b = compiler.binding(i.expr)
            if b is not None:
                new[i.name] = b
                continue
            c, kind = compiler.typed(i.expr)
            name = fresh("c")
            added[name] = c.cast("string") if isinstance(kind, T.NullType) else c
            new[i.name] = Scalar(name)
        return Frame(frame.df.withColumns(added) if added else frame.df, new)

    def aggregate(self, frame: Frame, items: list[Item]) -> Frame:
        """Implicit grouping: items without an aggregate are keys."""
        calls = [x for i in items for x in walk(i.expr) if is_aggregate(x)]
        for x in calls:
            if any(is_aggregate(y) for a in x.args for y in walk(a)):
                raise CypherError("InvalidAggregation", "an aggregate within an aggregate")
        frame, memo = self.prepare(frame, [i.expr for i in items if not has_aggregate(i.expr)] + [a for x in calls for a in x.args])
        keys = self.columns(frame, [i for i in items if not has_aggregate(i.expr)], memo)
        self._check_groups(items, frame)
        frame = Frame(keys.df, frame.vars)
        compiler = self.compiler(frame, memo)
        by = list(dict.fromkeys(key_of(b) for b in keys.vars.values()))
        carried = [x for x in dict.fromkeys(x for b in keys.vars.values() for x in b.columns()) if x not in by]
        aggs: list[Column] = [F.first(x).alias(x) for x in carried]
        placed: dict[int, str] = {}
        for x in calls:
            name = fresh("agg")
            placed[id(x)] = name
            if x.star:
                aggs.append(F.count(F.lit(1)).alias(name))
                continue
            b = compiler.binding(x.args[0])
            if x.name == "count" and isinstance(b, (Node, Edge, PathOf)):
                c, kind = F.col(key_of(b)), T.LongType()
            else:
                c, kind = compiler.typed(x.args[0])
            if x.name == "percentiledisc" and isinstance(kind, T.NumericType) and not x.distinct:
                # counts per value, combined before the shuffle; its syntax needs a column by name
                arg, share = fresh("arg"), self.constant(x.args[1]) if len(x.args) > 1 else 0.5
                frame = Frame(frame.df.withColumn(arg, c), frame.vars)
                aggs.append(F.expr(f"percentile_disc({float(share)}) WITHIN GROUP (ORDER BY `{arg}`)").cast(kind).alias(name))
                continue
            aggs.append(aggregates.build(x.name, c, kind, [compiler.column(a) for a in x.args[1:]], x.distinct).alias(name))
        df = frame.df.groupBy(*by).agg(*aggs) if by else frame.df.agg(*aggs)
        out = Frame(df, dict(keys.vars))
        for i in items:
            if has_aggregate(i.expr):
                name = placed.get(id(i.expr))
                if name is None:
                    name = fresh("c")
                    parts = {k: v for k, v in placed.items()}
                    for key in items:
                        if not has_aggregate(key.expr):
                            self._match_items(i.expr, [key], Frame(out.df, {key.name: keys.vars[key.name]}), parts)
                    out = Frame(out.df.withColumn(name, self.compiler(out, parts).column(i.expr)), out.vars)
                out.vars[i.name] = Scalar(name)
        return Frame(out.df, {i.name: out.vars[i.name] for i in items})

    def _check_groups(self, items: list[Item], frame: Frame) -> None:
        """Beside aggregates, an expression may use only what is grouped by."""
        simple = {i.expr.name for i in items if isinstance(i.expr, Var)}
        plain = [i.expr for i in items if not has_aggregate(i.expr)]

        def loose(e: Any) -> set[str]:
            if is_aggregate(e) or any(_same(e, p) for p in plain if isinstance(e, Expr)):
                return set()
            if isinstance(e, Var):
                return {e.name} - simple
            return set().union(*(loose(c) for c in children(e)), set())

        for i in items:
            if has_aggregate(i.expr) and (left := loose(i.expr) & set(frame.vars)):
                raise CypherError("AmbiguousAggregationExpression", ", ".join(sorted(left)))


def _wide(a: T.DataType, b: T.DataType) -> T.DataType:
    from lattica.model import widened

    return widened(a, b)


def _sorted(c: Column, kind: T.DataType, up: bool) -> Column:
    if isinstance(kind, T.MapType):
        c = F.to_json(c)
    return c.asc_nulls_last() if up else c.desc_nulls_first()


def _same(a: Any, b: Any) -> bool:
    """Whether two expressions read the same."""
    if type(a) is not type(b):
        return False
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b, strict=True))
    if hasattr(a, "__dict__"):
        return all(_same(getattr(a, k), getattr(b, k)) for k in vars(a))
    return a == b


def _renamed(b: Any, names: dict[str, str]) -> Any:
    n = lambda x: names.get(x, x) if x else x
    if isinstance(b, Node):
        return Node(n(b.id), n(b.labels), {p: n(c) for p, c in b.props.items()}, b.known)
    if isinstance(b, Edge):
        return Edge(n(b.id), n(b.src), n(b.dst), n(b.type), {p: n(c) for p, c in b.props.items()})
    if isinstance(b, PathOf):
        return PathOf(n(b.nodes), n(b.rels), [_renamed(p, names) for p in b.parts])
    return Scalar(n(b.col))


__all__ = ["CypherError", "Lowerer", "checkpointed"]
