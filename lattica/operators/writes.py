"""Clauses that write: each computes delta rows and gives the lowerer a new graph.

Rows are checkpointed before a write, so what a later clause sees doesn't depend on when Spark evaluates them.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import DST, ID, SRC, EdgeTable, NodeTable, PropertyGraph, checkpointed, indexed, stacked
from lattica.operators import hierarchy
from lattica.plans.ast import Command, Create, CypherError, Delete, Exists, Foreach, Func, HasLabels, Lit, MapLit, Match, Merge, NodePat, Param, Path, Project, RelPat, SetClause, SetItem, Unwind, Var
from lattica.plans.frame import Edge, Frame, Node, Scalar, entity, fresh, key_of


class Writer:
    """Executes writing clauses for a lowerer and leaves the new graph in it."""

    def clause(self, low: Any, frame: Frame, c: Any) -> Frame:
        frame = Frame(checkpointed(frame.df), frame.vars, frame.single)
        if isinstance(c, Create):
            for p in c.paths:
                frame = self.create(low, frame, p)
            return frame
        if isinstance(c, Merge):
            return self.merge(low, frame, c)
        if isinstance(c, SetClause):
            return self.set_all(low, frame, c.items)
        if isinstance(c, Delete):
            return self.delete(low, frame, c)
        if isinstance(c, Foreach):
            return self.foreach(low, frame, c)
        raise CypherError("Unsupported", type(c).__name__)

    # --- CREATE ---

    def properties(self, low: Any, frame: Frame, props: Any) -> dict[str, tuple[Column, T.DataType]]:
        items = props.items if isinstance(props, MapLit) else [(k, Lit(v)) for k, v in low.params.get(props.name, {}).items()] if isinstance(props, Param) else []
        return {k: low.compiler(frame).typed(v) for k, v in items}

    def create(self, low: Any, frame: Frame, path: Path) -> Frame:
        fresh_names = [n.var or fresh("anon") for n in path.nodes]
        for name, pat in zip(fresh_names, path.nodes, strict=True):
            if name in frame.vars:
                if pat.labels or pat.props is not None or not path.rels:
                    raise CypherError("CreateOnBoundVariable", name)
                frame = low.as_node(frame, name)
            else:
                frame = self.new_node(low, frame, name, pat)
        for k, rel in enumerate(path.rels):
            if rel.span is not None:
                raise CypherError("CreateVariableLengthRelationship", ":".join(rel.types))
            if len(rel.types) != 1:
                raise CypherError("CreateRelationshipWithoutType", str(rel.types))
            if rel.direction == "both":
                raise CypherError("CreateUndirectedRelationship", rel.types[0])
            if rel.var and rel.var in frame.vars:
                raise CypherError("CreateOnBoundRelationship", rel.var)
            a, b = (fresh_names[k], fresh_names[k + 1]) if rel.direction == "out" else (fresh_names[k + 1], fresh_names[k])
            frame = self.new_edge(low, frame, rel.var or fresh("rel"), rel, a, b)
        return frame

    def new_node(self, low: Any, frame: Frame, name: str, pat: NodePat) -> Frame:
        props = {k: (c, t) for k, (c, t) in self.properties(low, frame, pat.props).items()}
        node = Node(fresh("n"), fresh("l"), {p: fresh("p") for p in props}, frozenset(pat.labels))
        df = frame.df.withColumns({node.props[p]: c.cast("string") if isinstance(t, T.NullType) else c for p, (c, t) in props.items()}) if props else frame.df
        df = df.withColumn(node.labels, F.array(*[F.lit(x) for x in sorted(pat.labels)]).cast("array<string>"))
        df = checkpointed(indexed(df, node.id, low.graph.next_id()))
        rows = df.select(F.col(node.id).alias(ID), *[F.col(c).alias(p) for p, c in node.props.items() if not isinstance(props[p][1], T.NullType)])
        low.graph = self.add_nodes(self.counted(low.graph, df), frozenset(pat.labels), rows)
        return Frame(df, frame.vars | {name: node})

    def new_edge(self, low: Any, frame: Frame, name: str, rel: RelPat, a: str, b: str) -> Frame:
        props = self.properties(low, frame, rel.props)
        edge = Edge(fresh("e"), fresh("s"), fresh("d"), fresh("t"), {p: fresh("p") for p in props})
        df = frame.df.withColumns({edge.src: F.col(frame.vars[a].id), edge.dst: F.col(frame.vars[b].id), edge.type: F.lit(rel.types[0])} | {edge.props[p]: c.cast("string") if isinstance(t, T.NullType) else c for p, (c, t) in props.items()})
        df = checkpointed(indexed(df, edge.id, low.graph.next_id()))
        rows = df.where(F.col(edge.src).isNotNull() & F.col(edge.dst).isNotNull()).select(*[F.col(getattr(edge, x)).alias(y) for x, y in (("id", ID), ("src", SRC), ("dst", DST))], *[F.col(c).alias(p) for p, c in edge.props.items() if not isinstance(props[p][1], T.NullType)])
        low.graph = self.add_edges(self.counted(low.graph, df), rel.types[0], rows)
        return Frame(df, frame.vars | {name: edge})

    @staticmethod
    def counted(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
        """The graph with the ids of new rows marked as used."""
        return replace(graph, meta={**graph.meta, "next_id": graph.next_id() + rows.count()})

    @staticmethod
    def label_sets(frame: Frame, b: Node) -> set[frozenset[str]]:
        """The label sets that the nodes of a variable carry: as many rows as there are tables at most."""
        if not b.labels:
            return {b.known}
        return {frozenset(r[0]) for r in frame.df.select(b.labels).distinct().collect() if r[0] is not None}

    def add_nodes(self, graph: PropertyGraph, labels: frozenset[str], rows: DataFrame) -> PropertyGraph:
        out, done = [], False
        for t in graph.nodes:
            if t.labels == labels:
                out.append(NodeTable(labels, stacked([t.df, rows])))
                done = True
            else:
                out.append(t)
        graph = graph.with_nodes(out if done else [*out, NodeTable(labels, rows)])
        self.check_unique(graph, labels)
        return graph

    @staticmethod
    def check_unique(graph: PropertyGraph, labels: frozenset[str]) -> None:
        for label, prop in graph.meta.get("unique", []):
            if label in labels and prop in graph.props_of([label]):
                twice = graph.scan([label], [prop]).where(F.col(f"`{prop}`").isNotNull()).groupBy(f"`{prop}`").count().where("count > 1")
                if not twice.isEmpty():
                    raise CypherError("ConstraintViolation", f"{label}.{prop} must be unique")

    @staticmethod
    def add_edges(graph: PropertyGraph, type_: str, rows: DataFrame) -> PropertyGraph:
        out, done = [], False
        for t in graph.edges:
            if t.type == type_ and not done:
                out.append(EdgeTable(type_, stacked([t.df, rows])))
                done = True
            else:
                out.append(t)
        return graph.with_edges(out if done else [*out, EdgeTable(type_, rows)])

    # --- MERGE ---

    def merge(self, low: Any, frame: Frame, c: Merge) -> Frame:
        path = c.path
        for rel in path.rels:
            if rel.span is not None:
                raise CypherError("MergeVariableLengthRelationship", "")
            if len(rel.types) != 1:
                raise CypherError("MergeRelationshipWithoutType", str(rel.types))
            for k, (_, t) in self.properties(low, frame, rel.props).items() if rel.props is not None else []:
                if isinstance(t, T.NullType):
                    raise CypherError("MergeRelationshipWithNullProperty", k)
        if len(path.nodes) == 1 and path.nodes[0].var in frame.vars:
            raise CypherError("MergeOnBoundVariable", str(path.nodes[0].var))
        named = Path(path.var, [replace(n, var=n.var or fresh("m")) for n in path.nodes], [replace(r, var=r.var or fresh("m")) for r in path.rels])
        row = fresh("row")
        frame = Frame(checkpointed(indexed(frame.df, row)), frame.vars | {f"_{row}": Scalar(row)})
        before = low.match(frame, [named], None)
        matched = checkpointed(before.df.select(row).distinct())
        missing = Frame(checkpointed(frame.df.join(matched, row, "left_anti").select(*frame.df.columns)), frame.vars)
        had = before.vars
        old_ids = checkpointed(before.df.select(*list(dict.fromkeys([row, *[key_of(had[n.var]) for n in (*named.nodes, *named.rels)]]))))
        if not missing.df.isEmpty():
            # one creation per distinct pattern: rows whose values are equal share it
            values = [v for x in (*named.nodes, *named.rels) for v in self.properties(low, missing, x.props).values()]
            keys = {fresh("k"): v for v in [x for x, _ in values]} | {fresh("k"): F.col(missing.vars[n.var].id) for n in named.nodes if n.var in missing.vars and isinstance(missing.vars[n.var], Node)}
            keyed = missing.df.withColumns(keys) if keys else missing.df
            first = keyed.dropDuplicates(list(keys)) if keys else keyed.limit(1)
            directed = Path(None, named.nodes, [replace(r, direction="out" if r.direction == "both" else r.direction) for r in named.rels])
            self.create_missing(low, Frame(checkpointed(first.select(*missing.df.columns)), missing.vars), directed)
        after = low.match(frame, [named], None)
        if c.on_create or c.on_match:
            ids = [key_of(after.vars[n.var]) for n in (*named.nodes, *named.rels)]
            old = [key_of(had[n.var]) for n in (*named.nodes, *named.rels)]
            marker = fresh("was")
            seen = old_ids.select(F.col(row).alias(f"{row}_o"), *[F.col(o).alias(f"{marker}_{k}") for k, o in enumerate(old)]).distinct()
            on = reduce(lambda a, b: a & b, [F.col(row) == F.col(f"{row}_o"), *[F.col(i) == F.col(f"{marker}_{k}") for k, i in enumerate(ids)]])
            flagged = checkpointed(after.df.join(seen, on, "left").withColumn(marker, F.col(f"{row}_o").isNotNull()).select(*after.df.columns, marker))
            for items, flag in ((c.on_create, False), (c.on_match, True)):
                part = Frame(flagged.where(F.col(marker) if flag else ~F.col(marker)), after.vars)
                if items and not part.df.isEmpty():
                    self.set_all(low, part, items)
            after = low.match(frame, [named], None)
        visible = {n: b for n, b in after.vars.items() if not n.startswith("_")}
        return Frame(checkpointed(after.df), visible)

    def create_missing(self, low: Any, frame: Frame, path: Path) -> None:
        bound = {n.var for n in path.nodes if n.var in frame.vars}
        nodes = [replace(n, labels=[], props=None) if n.var in bound else n for n in path.nodes]
        for n in nodes:
            if n.var in bound:
                frame = low.as_node(frame, n.var)
        if path.rels or not bound:
            self.create(low, frame, Path(None, nodes, path.rels))

    # --- SET, REMOVE ---

    def set_all(self, low: Any, frame: Frame, items: list[SetItem]) -> Frame:
        for item in items:
            if any(isinstance(x, Exists) for x in ([item.value] if item.value is not None else [])):
                raise CypherError("PatternInSetValue", item.var)
            if item.var not in frame.vars:
                raise CypherError("UndefinedVariable", item.var)
            b = frame.vars[item.var]
            if isinstance(b, Scalar):
                frame = low.as_node(frame, item.var)
                b = frame.vars[item.var]
            frame = self.relabel(low, frame, item, b) if item.kind in ("labels", "drop_labels") else self.assign(low, frame, item, b)
        return frame

    def values_of(self, low: Any, frame: Frame, item: SetItem) -> dict[str, tuple[Column, T.DataType]]:
        if item.kind == "prop":
            frame2, memo = low.prepare(frame, [item.value])
            if memo:
                raise CypherError("PatternInSetValue", item.var)
            return {item.key: low.compiler(frame2).typed(item.value)}
        if item.kind == "drop_prop":
            return {item.key: (F.lit(None), T.NullType())}
        if isinstance(item.value, MapLit):
            return {k: low.compiler(frame).typed(v) for k, v in item.value.items}
        if isinstance(item.value, Param):
            return {k: low.compiler(frame).typed(Lit(v)) for k, v in low.params[item.value.name].items()}
        other = low.compiler(frame).binding(item.value)
        if isinstance(other, (Node, Edge)):
            return {p: (F.col(c), frame.probe(F.col(c))) for p, c in other.props.items()}
        c, kind = low.compiler(frame).typed(item.value)
        if isinstance(kind, T.StructType):
            return {f.name: (c[f.name], f.dataType) for f in kind.fields if not f.name.startswith("__")}
        raise CypherError("TypeError", "SET needs a map or an entity")

    def assign(self, low: Any, frame: Frame, item: SetItem, b: Node | Edge) -> Frame:
        values = self.values_of(low, frame, item)
        wanted = {p: (f"__v{k}", c, t) for k, (p, (c, t)) in enumerate(values.items())}
        delta = frame.df.where(F.col(b.id).isNotNull()).select(F.col(b.id).alias("__u"), *[(c.cast("string") if isinstance(t, T.NullType) else c).alias(n) for n, c, t in wanted.values()])
        delta = checkpointed(delta.groupBy("__u").agg(*([F.last(n).alias(n) for n, _, _ in wanted.values()] or [F.lit(1).alias("__one")])))  # of several rows for an entity, the last

        def changed(df: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
            joined = df.join(delta, df[ID] == delta["__u"], "left")
            columns = []
            for p in [c for c in df.columns if c not in fixed]:
                if p in wanted:
                    continue
                keep = F.when(F.col("__u").isNull(), F.col(f"`{p}`")) if item.kind == "replace" else F.col(f"`{p}`")
                columns.append(keep.alias(p))
            for p, (n, _, t) in wanted.items():
                if p not in df.columns:
                    if not isinstance(t, T.NullType):
                        columns.append(F.when(F.col("__u").isNotNull(), F.col(n)).alias(p))
                    continue
                have = df.schema[p].dataType
                from lattica.model import widened

                kind = have if isinstance(t, T.NullType) else widened(have, t)
                columns.append(F.when(F.col("__u").isNotNull(), F.lit(None).cast(kind) if isinstance(t, T.NullType) else F.col(n).cast(kind)).otherwise(F.col(f"`{p}`").cast(kind)).alias(p))
            return checkpointed(joined.select(*fixed, *columns))

        if isinstance(b, Node):
            sets = self.label_sets(frame, b)
            low.graph = low.graph.with_nodes([NodeTable(t.labels, changed(t.df, (ID,))) if t.labels in sets else t for t in low.graph.nodes])
            self.check_unique(low.graph, frozenset().union(*sets))
        else:
            touched = {r[0] for r in frame.df.select(b.type).distinct().collect()}
            low.graph = low.graph.with_edges([EdgeTable(t.type, changed(t.df, (ID, SRC, DST)), t.src_label, t.dst_label) if t.type in touched else t for t in low.graph.edges])
        return self.reread(low, frame)

    def reread(self, low: Any, frame: Frame, moved: set[frozenset[str]] | None = None) -> Frame:
        """The frame with the entities' properties and labels as the graph has them now."""
        df, new = frame.df, dict(frame.vars)
        for name, b in frame.vars.items():
            if isinstance(b, Node):
                tables = self.label_sets(frame, b) | (moved or set())
                whole, low.graph = low.graph, low.graph.with_nodes([t for t in low.graph.nodes if t.labels in tables])
                node, nodes = low.nodes_as(())
                low.graph = whole
                df = df.join(nodes, F.col(b.id) == F.col(node.id), "left")
                new[name] = replace(node, known=frozenset())
            elif isinstance(b, Edge):
                kinds = [r[0] for r in frame.df.select(b.type).distinct().collect() if r[0] is not None]
                edge, edges = low.edges_as(kinds or ("\0none",))
                df = df.join(edges, (F.col(b.id) == F.col(edge.id)) & (F.col(b.type) == F.col(edge.type)), "left")
                new[name] = edge
        return Frame(checkpointed(df.select(*list(dict.fromkeys([*[x for b in new.values() for x in b.columns()], *[c for c in frame.df.columns if c.startswith("_row")]])))), new)

    def relabel(self, low: Any, frame: Frame, item: SetItem, b: Node) -> Frame:
        ids = checkpointed(frame.df.select(F.col(b.id).alias("__u")).where("__u is not null").distinct())
        tables: dict[frozenset, list[Any]] = {}
        sets, touched = self.label_sets(frame, b), set()
        for t in low.graph.nodes:
            if t.labels not in sets:
                tables.setdefault(t.labels, []).append(t)
                continue
            to = t.labels | set(item.labels) if item.kind == "labels" else t.labels - set(item.labels)
            touched.add(frozenset(to))
            if to == t.labels:
                tables.setdefault(t.labels, []).append(t)
                continue
            moved = t.df.join(ids, t.df[ID] == ids["__u"], "left_semi")
            tables.setdefault(t.labels, []).append(t.df.join(ids, t.df[ID] == ids["__u"], "left_anti"))
            tables.setdefault(frozenset(to), []).append(moved)
        low.graph = low.graph.with_nodes([v[0] if len(v) == 1 and isinstance(v[0], NodeTable) else NodeTable(k, checkpointed(stacked([x.df if isinstance(x, NodeTable) else x for x in v]))) for k, v in tables.items()])
        # ends that were known to carry one label set may no longer do so
        low.graph = low.graph.with_edges([EdgeTable(e.type, e.load) for e in low.graph.edges])
        return self.reread(low, frame, touched)

    # --- DELETE ---

    def delete(self, low: Any, frame: Frame, c: Delete) -> Frame:
        for e in c.exprs:
            b = low.compiler(frame).binding(e)
            if b is None and isinstance(e, Var):
                raise CypherError("UndefinedVariable", e.name)
            if isinstance(b, Node):
                ids = checkpointed(frame.df.select(F.col(b.id).alias("__u")).where("__u is not null").distinct())
                reach = [t for t in low.graph.edges if any(x is None or any(x in labels for labels in self.label_sets(frame, b)) for x in (t.src_label, t.dst_label))]
                touching = [t.df.select(F.col(SRC).alias("__u")).union(t.df.select(F.col(DST).alias("__u"))).join(ids, "__u", "left_semi") for t in reach]
                if not c.detach and any(not t.isEmpty() for t in touching):
                    raise CypherError("DeleteConnectedNode", "use DETACH DELETE")
                sets = self.label_sets(frame, b)
                low.graph = low.graph.with_nodes([NodeTable(t.labels, checkpointed(t.df.join(ids, t.df[ID] == ids["__u"], "left_anti"))) if t.labels in sets else t for t in low.graph.nodes])
                if c.detach:
                    low.graph = low.graph.with_edges([EdgeTable(t.type, checkpointed(t.df.join(ids, t.df[SRC] == ids["__u"], "left_anti").join(ids, F.col(DST) == ids["__u"], "left_anti")), t.src_label, t.dst_label) if t in reach else t for t in low.graph.edges])
            else:
                if isinstance(b, Edge):
                    ids = frame.df.select(F.col(b.id).alias("__u"), F.col(b.type).alias("__t"))
                else:
                    x, kind = low.compiler(frame).typed(e)
                    if entity(kind) != "edge":
                        raise CypherError("TypeError", "DELETE needs an entity")
                    ids = frame.df.select(x[ID].alias("__u"), x["__type"].alias("__t"))
                ids = checkpointed(ids.where("__u is not null").distinct())
                low.graph = low.graph.with_edges([EdgeTable(t.type, checkpointed(t.df.join(ids.where(F.col("__t") == t.type), t.df[ID] == ids["__u"], "left_anti")), t.src_label, t.dst_label) for t in low.graph.edges])
        return frame

    # --- FOREACH ---

    def foreach(self, low: Any, frame: Frame, c: Foreach) -> Frame:
        inner = low.unwind(frame, Unwind(c.source, c.var))
        for step in c.body:
            if isinstance(step, Create) and any(p.rels for p in step.paths):
                raise CypherError("Unsupported", "a relationship in FOREACH")
            inner = self.clause(low, inner, step)
        return self.reread(low, frame) if any(isinstance(b, (Node, Edge)) for b in frame.vars.values()) else frame

    # --- definitions ---

    def command(self, low: Any, c: Command) -> DataFrame:
        graph: PropertyGraph = low.graph
        meta = {k: (dict(v) if isinstance(v, dict) else list(v) if isinstance(v, list) else v) for k, v in graph.meta.items() if k != "_derived"}
        a, spark = c.args, graph.spark
        nothing = spark.createDataFrame([], "`rows` long").select()
        if c.kind == "show_indexes":
            rows = [(x, p, "BTREE") for x, p in meta.get("indexes", [])] + [(x, p, "VECTOR") for x, p in meta.get("vectors", {})]
            return spark.createDataFrame(sorted(rows), "label string, property string, type string")
        if c.kind == "show_constraints":
            return spark.createDataFrame(sorted((x, p, "UNIQUE") for x, p in meta.get("unique", [])), "label string, property string, type string")
        if c.kind == "show_vectors":
            return spark.createDataFrame(sorted((v["name"], k[0], k[1], int(v["dimensions"]), str(v["similarity"])) for k, v in meta.get("vectors", {}).items()), "name string, label string, property string, dimensions int, similarity string")
        if c.kind == "show_hierarchies":
            rows = [(s["name"], ",".join(s["types"]), ".".join(s["measure"]) if s["measure"] else None, ",".join(s["aggregates"])) for s in meta.get("hierarchies", {}).values()]
            return spark.createDataFrame(sorted(rows), "name string, types string, measure string, aggregates string")
        if c.kind == "create_index":
            meta["indexes"] = sorted({*map(tuple, meta.get("indexes", [])), *((a["label"], p) for p in a["props"])})
        elif c.kind == "drop_index":
            gone = {(a["label"], p) for p in a["props"]}
            if not gone & set(map(tuple, meta.get("indexes", []))):
                raise CypherError("UnknownIndex", str(sorted(gone)))
            meta["indexes"] = [x for x in meta.get("indexes", []) if tuple(x) not in gone]
        elif c.kind == "create_constraint":
            meta["unique"] = sorted({*map(tuple, meta.get("unique", [])), (a["label"], a["prop"])})
            self.check_unique(replace(graph, meta=meta), frozenset([a["label"]]))
        elif c.kind == "create_vector":
            meta.setdefault("vectors", {})[(a["label"], a["prop"])] = a
        elif c.kind == "create_hierarchy":
            if a["name"] in meta.get("hierarchies", {}):
                raise CypherError("DuplicateHierarchy", a["name"])
            bad = set(a["aggregates"]) - set(hierarchy.AGGREGATES)
            if bad:
                raise CypherError("UnknownAggregate", ", ".join(sorted(bad)))
            hierarchy.closure(replace(graph, meta=meta), a)  # refuses cycles
            meta.setdefault("hierarchies", {})[a["name"]] = a
        elif c.kind in ("drop_hierarchy", "rebuild_hierarchy"):
            if a["name"] not in meta.get("hierarchies", {}):
                raise CypherError("UnknownHierarchy", a["name"])
            graph.meta.get("_derived", {}).pop(a["name"], None)
            if c.kind == "drop_hierarchy":
                del meta["hierarchies"][a["name"]]
            else:
                hierarchy.closure(replace(graph, meta=meta), meta["hierarchies"][a["name"]])  # anew; refuses cycles
        low.graph = replace(graph, meta=meta)
        return nothing


__all__ = ["Func", "HasLabels", "Match", "Project", "Writer"]
