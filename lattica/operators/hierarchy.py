"""Hierarchies: closure of a covering relation, subsumption, roll-up and lowest common ancestors.

An index is a definition in the graph's meta: covering types, their direction, a measure. Its closure is derived
from the graph it is asked of, so writes can't leave it stale.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import DST, ID, SRC, PropertyGraph, checkpointed
from lattica.plans.ast import CypherError, Func, Lit
from lattica.plans.frame import Node, fresh

FUNCTIONS = {"subsumes", "hierarchy_rollup", "hierarchy_lca"}
AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def covering(graph: PropertyGraph, spec: dict) -> DataFrame:
    """(child, parent) edges."""
    edges = graph.scan_edges(spec["types"], [])
    a, b = (DST, SRC) if spec["reverse"] else (SRC, DST)
    return edges.select(F.col(a).alias("child"), F.col(b).alias("parent")).distinct()


def closure(graph: PropertyGraph, spec: dict) -> DataFrame:
    """(desc, anc): every node of the hierarchy with itself and each of its ancestors, once. Cycles are refused."""
    cache = graph.meta.setdefault("_derived", {})
    of, known = cache.get(spec["name"], (None, None))
    if of is graph.edges:  # of these very relationships: the cache holds them, so that no other can take their place
        return known
    up = checkpointed(covering(graph, spec))
    nodes = up.select(F.col("child").alias("x")).union(up.select("parent")).distinct()
    seen = checkpointed(up.select(F.col("child").alias("desc"), F.col("parent").alias("anc")).distinct())
    frontier = seen
    while not frontier.isEmpty():
        if not frontier.where("desc = anc").isEmpty():
            raise CypherError("HierarchyCycle", spec["name"])
        nexts = frontier.join(up, frontier["anc"] == up["child"]).select("desc", F.col("parent").alias("anc")).distinct()
        frontier = checkpointed(nexts.join(seen, ["desc", "anc"], "left_anti"))
        seen = checkpointed(seen.unionByName(frontier))
    known = checkpointed(seen.unionByName(nodes.select(F.col("x").alias("desc"), F.col("x").alias("anc"))))
    cache[spec["name"]] = (graph.edges, known)
    return known


def spec_of(graph: PropertyGraph, name: str | None) -> dict:
    specs = graph.meta.get("hierarchies", {})
    if name is None and len(specs) == 1:
        return next(iter(specs.values()))
    if name not in specs:
        raise CypherError("UnknownHierarchy", str(name) if name else "name one of several, or define one")
    return specs[name]


def measure(graph: PropertyGraph, spec: dict) -> DataFrame:
    """(id, m): the measure of nodes that have it as a number; truth values count as 1 and 0."""
    if spec["measure"] is None:
        return graph.scan((), []).select(F.col(ID).alias("id"), F.lit(None).cast("long").alias("m"))
    label, prop = spec["measure"]
    df = graph.scan([label], [prop])
    kind = df.schema[prop].dataType if prop in df.columns else T.NullType()
    c = F.col(f"`{prop}`") if isinstance(kind, T.NumericType) else F.col(f"`{prop}`").cast("int") if isinstance(kind, T.BooleanType) else F.lit(None).cast("long")
    return df.select(F.col(ID).alias("id"), c.alias("m"))


def rollup(graph: PropertyGraph, spec: dict, op: str) -> DataFrame:
    """(anc, value): the measure folded over each node and its descendants, each once."""
    if op not in (spec["aggregates"] or AGGREGATES):
        raise CypherError("UnknownAggregate", f"{op} is none of {', '.join(spec['aggregates'] or AGGREGATES)}")
    both = closure(graph, spec).join(measure(graph, spec), F.col("desc") == F.col("id"))
    return both.groupBy("anc").agg(AGGREGATES[op]("m").alias("value"))


def lower(lowerer: Any, frame: Any, e: Func, memo: dict[int, Any]) -> Any:
    """Lower one of FUNCTIONS to a join with the closure or what is derived from it."""
    graph, compiler = lowerer.graph, lowerer.compiler(frame, memo)
    ids = []
    for a in e.args[: 1 if e.name == "hierarchy_rollup" else 2]:
        b = compiler.binding(a)
        c, kind = (F.col(b.id), None) if isinstance(b, Node) else compiler.typed(a)
        ids.append(c if kind is None or isinstance(kind, T.LongType) else c[ID])
    name, extra = fresh("h"), e.args[1:] if e.name == "hierarchy_rollup" else e.args[2:]
    words = [a.value for a in extra if isinstance(a, Lit)]
    spec = spec_of(graph, words[-1] if len(words) > (1 if e.name == "hierarchy_rollup" else 0) else None)
    if e.name == "hierarchy_rollup":
        folded = rollup(graph, spec, str(words[0]).lower() if words else "sum")
        k, v = fresh("k"), fresh("v")
        df = frame.df.join(folded.select(F.col("anc").alias(k), F.col("value").alias(v)), ids[0] == F.col(k), "left").drop(k).withColumnRenamed(v, name)
    elif e.name == "subsumes":
        d, a = fresh("d"), fresh("a")
        asked = frame.df.select(ids[1].alias("anc")).where("anc is not null").distinct()  # of the closure, only what lies below these
        pairs = closure(graph, spec).join(asked, "anc", "left_semi").select(F.col("desc").alias(d), F.col("anc").alias(a), F.lit(True).alias(name))
        df = frame.df.join(pairs, (ids[0] == F.col(d)) & (ids[1] == F.col(a)), "left").drop(d, a)
        df = df.withColumn(name, F.when(ids[0].isNotNull() & ids[1].isNotNull(), F.coalesce(F.col(name), ids[0] == ids[1])))
    else:
        x, y = fresh("x"), fresh("y")
        df = frame.df.withColumns({x: ids[0], y: ids[1]})
        asked = df.select(x, y).where(f"`{x}` is not null and `{y}` is not null").distinct()
        found = lowest_common(graph, spec, asked.select(F.col(x).alias("x"), F.col(y).alias("y"))).select(F.col("x").alias(x), F.col("y").alias(y), F.col("lca").alias(name))
        df = df.join(found, [x, y], "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    memo[id(e)] = name
    return frame.having(df)


def lowest_common(graph: PropertyGraph, spec: dict, pairs: DataFrame) -> DataFrame:
    """(x, y, lca): the common ancestors that lie above no other common one, ascending."""
    up = closure(graph, spec)
    one, two = up.select(F.col("desc").alias("x"), F.col("anc").alias("c")), up.select(F.col("desc").alias("y"), F.col("anc").alias("c"))
    common = checkpointed(pairs.join(one, "x").join(two, ["y", "c"]).select("x", "y", "c"))
    lower_ = common.select("x", "y", F.col("c").alias("desc")).join(up.where("desc <> anc"), "desc").select("x", "y", F.col("anc").alias("c")).distinct()
    return common.join(lower_, ["x", "y", "c"], "left_anti").groupBy("x", "y").agg(F.array_sort(F.collect_list("c")).alias("lca"))
