"""Expressions to Columns, with static types and three-valued logic."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import scalar as S
from lattica.functions.aggregates import NAMES as AGGREGATES
from lattica.model import DST, ID, SRC, widened
from lattica.plans.ast import (
    Binary, Case, CypherError, Exists, Expr, Func, HasLabels, Index, IsNull, ListComp, ListLit, Lit, MapLit, Param, PatternComp, Prop, Quantifier, Reduce, Slice, Unary, Var, walk,
)
from lattica.plans.frame import Edge, Frame, Node, PathOf, Scalar, entity

NULL = T.NullType()


def is_aggregate(e: Any) -> bool:
    return isinstance(e, Func) and (e.name in AGGREGATES or e.star)


def has_aggregate(e: Any) -> bool:
    return any(is_aggregate(x) for x in walk(e))


def free_vars(e: Any) -> set[str]:
    """Names that an expression reads from outside itself."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, (ListComp, Quantifier)):
        inner = set().union(*(free_vars(x) for x in (e.where, getattr(e, "to", None)) if x is not None), set()) - {e.var}
        return inner | free_vars(e.source)
    if isinstance(e, Reduce):
        return free_vars(e.init) | free_vars(e.source) | (free_vars(e.step) - {e.var, e.acc})
    if isinstance(e, (Exists, PatternComp)):
        names = {x.var for x in walk(e) if hasattr(x, "var") and not isinstance(x, Expr) and x.var}
        return names | {x.name for x in walk(e) if isinstance(x, Var)}
    from lattica.plans.ast import children

    return set().union(*(free_vars(c) for c in children(e)), set())


def comparable(a: T.DataType, b: T.DataType) -> bool:
    for group in (S.NUMERIC, (T.StringType,), (T.BooleanType,), S.TIMES, (T.ArrayType,)):
        if isinstance(a, group):
            return isinstance(b, group)
    return a == b


class Expressions:
    """Compiles expressions over a frame. ``memo`` has columns for parts that were lowered to joins before."""

    def __init__(self, frame: Frame, params: dict[str, Any], memo: dict[int, Any], local: dict[str, tuple[Column, Column]] | None = None):
        self.frame, self.params, self.memo, self.local = frame, params, memo, local or {}

    def inside(self, **local: tuple[Column, T.DataType]) -> Expressions:
        """With lambda variables; each has a typed null beside it, by which types are found."""
        return Expressions(self.frame, self.params, self.memo, self.local | {k: (c, F.lit(None).cast(t)) for k, (c, t) in local.items()})

    def typed(self, e: Expr) -> tuple[Column, T.DataType]:
        c = self.column(e)
        if isinstance(e, Var) and e.name in self.local:
            return c, self.frame.probe(self.local[e.name][1])
        shadow = Expressions(self.frame, self.params, self.memo, {k: (p, p) for k, (_, p) in self.local.items()}).column(e) if self.local else c
        return c, self.frame.probe(shadow)

    def column(self, e: Expr) -> Column:
        if id(e) in self.memo:
            m = self.memo[id(e)]
            return m.whole() if not isinstance(m, str) else F.col(m)
        return getattr(self, "_" + type(e).__name__.lower())(e)

    # --- leaves ---

    def _value(self, v: Any) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[self._value(x) for x in v]) if v else F.array()
        if isinstance(v, dict):
            return F.struct(*[self._value(x).alias(k) for k, x in v.items()])
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long")
        return F.lit(v)

    def _lit(self, e: Lit) -> Column:
        return self._value(e.value)

    def _param(self, e: Param) -> Column:
        if e.name not in self.params:
            raise CypherError("MissingParameter", e.name)
        return self._value(self.params[e.name])

    def _var(self, e: Var) -> Column:
        if e.name in self.local:
            return self.local[e.name][0]
        if e.name not in self.frame.vars:
            raise CypherError("UndefinedVariable", e.name)
        return self.frame.vars[e.name].whole()

    def binding(self, e: Expr):
        m = self.memo.get(id(e))
        if m is not None and not isinstance(m, str):
            return m
        return self.frame.vars.get(e.name) if isinstance(e, Var) and e.name not in self.local else None

    def _prop(self, e: Prop) -> Column:
        b = self.binding(e.of)
        if isinstance(b, (Node, Edge)):
            return F.col(b.props[e.key]) if e.key in b.props else F.lit(None)
        c, kind = self.typed(e.of)
        return self.member(c, kind, e.key)

    def member(self, c: Column, kind: T.DataType, key: str) -> Column:
        part = S.component(c, kind, key)
        if part is not None:
            return part
        if isinstance(kind, T.StructType):
            return c[key] if key in kind.fieldNames() else F.lit(None)
        if isinstance(kind, T.MapType):
            return F.try_element_at(c, F.lit(key))
        return F.lit(None)

    # --- lists and maps ---

    def _listlit(self, e: ListLit) -> Column:
        return self.array([self.typed(x) for x in e.items])

    def array(self, parts: list[tuple[Column, T.DataType]]) -> Column:
        if not parts:
            return F.array()
        kind: T.DataType = NULL
        for _, t in parts:
            kind = widened(kind, t)
        return F.array(*[self.cast(c, t, kind) for c, t in parts])

    @staticmethod
    def cast(c: Column, have: T.DataType, want: T.DataType) -> Column:
        if have == want or isinstance(want, T.NullType):
            return c
        return S.to_string(c, have) if isinstance(want, T.StringType) and not isinstance(have, (T.NullType, T.ArrayType, T.StructType)) else c.cast(want)

    def _maplit(self, e: MapLit) -> Column:
        return F.struct(*[self.column(v).alias(k) for k, v in e.items]) if e.items else F.create_map().cast("map<string,string>")

    def _index(self, e: Index) -> Column:
        c, kind = self.typed(e.of)
        if isinstance(e.at, Lit) and isinstance(e.at.value, str):
            b = self.binding(e.of)
            return self._prop(Prop(e.of, e.at.value)) if isinstance(b, (Node, Edge)) else self.member(c, kind, e.at.value)
        at = self.column(e.at)
        if isinstance(kind, T.MapType):
            return F.try_element_at(c, at)
        at = at.cast("int")
        return F.when(at >= 0, F.get(c, at)).otherwise(F.when(-at <= F.size(c), F.get(c, F.size(c) + at)))

    def _slice(self, e: Slice) -> Column:
        c = self.column(e.of)
        n = F.size(c)
        place = lambda x, d: d if x is None else (lambda k: F.least(F.greatest(F.when(k < 0, n + k).otherwise(k), F.lit(0)), n))(self.column(x).cast("int"))
        low, high = place(e.low, F.lit(0)), place(e.high, n)
        return F.slice(c, low + 1, F.greatest(high - low, F.lit(0)))

    def _listcomp(self, e: ListComp) -> Column:
        c, kind = self.typed(e.source)
        element = kind.elementType if isinstance(kind, T.ArrayType) else NULL
        if e.where is not None:
            c = F.filter(c, lambda x: self.inside(**{e.var: (x, element)}).column(e.where))
        if e.to is not None:
            c = F.transform(c, lambda x: self.inside(**{e.var: (x, element)}).column(e.to))
        return c

    def _quantifier(self, e: Quantifier) -> Column:
        c, kind = self.typed(e.source)
        element = kind.elementType if isinstance(kind, T.ArrayType) else NULL
        test = lambda x: self.inside(**{e.var: (x, element)}).column(e.where)
        if e.kind == "all":
            return F.forall(c, test)
        if e.kind == "single":
            return F.size(F.filter(c, test)) == 1
        return F.exists(c, test) if e.kind == "any" else ~F.exists(c, test)

    def _reduce(self, e: Reduce) -> Column:
        init, start = self.typed(e.init)
        c, kind = self.typed(e.source)
        element = kind.elementType if isinstance(kind, T.ArrayType) else NULL
        blank = F.lit(None).cast(start)
        _, step = self.inside(**{e.acc: (blank, start), e.var: (F.lit(None).cast(element), element)}).typed(e.step)
        to = widened(start, step)
        return F.aggregate(c, init.cast(to), lambda a, x: self.inside(**{e.acc: (a, to), e.var: (x, element)}).column(e.step).cast(to))

    # --- logic ---

    def _unary(self, e: Unary) -> Column:
        return ~self.boolean(e.of) if e.op == "NOT" else -self.column(e.of)

    def boolean(self, e: Expr) -> Column:
        c = self.column(e)
        return c.cast("boolean") if isinstance(e, Lit) and e.value is None else c

    def _isnull(self, e: IsNull) -> Column:
        b = self.binding(e.of)
        c = F.col(b.id) if isinstance(b, (Node, Edge)) else self.column(e.of)
        return c.isNotNull() if e.negated else c.isNull()

    def _haslabels(self, e: HasLabels) -> Column:
        b = self.binding(e.of)
        if isinstance(b, Node) and b.labels is None:
            ok = F.lit(set(e.labels) <= b.known)
            return F.when(F.col(b.id).isNotNull(), ok)
        if isinstance(b, Edge):
            return F.col(b.type).isin(e.labels)
        labels = F.col(b.labels) if isinstance(b, Node) else self.column(e.of)["__labels"]
        out = F.lit(True)
        for x in e.labels:
            out = out & F.array_contains(labels, x)
        return out

    def _binary(self, e: Binary) -> Column:
        if e.op in ("AND", "OR", "XOR"):
            a, b = self.boolean(e.left), self.boolean(e.right)
            return a & b if e.op == "AND" else a | b if e.op == "OR" else a != b
        bind_a, bind_b = self.binding(e.left), self.binding(e.right)
        if isinstance(bind_a, (Node, Edge)) and isinstance(bind_b, (Node, Edge)) and e.op in ("=", "<>"):
            a, b = F.col(bind_a.id), F.col(bind_b.id)
            return a == b if e.op == "=" else a != b
        (a, ta), (b, tb) = self.typed(e.left), self.typed(e.right)
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(e.op, a, ta, b, tb)
        if e.op == "IN":
            return self.member_of(a, ta, b, tb, e.right)
        if e.op in ("STARTS", "ENDS", "CONTAINS", "=~"):
            if not (isinstance(ta, T.StringType) and isinstance(tb, T.StringType)):
                return F.lit(None).cast("boolean")
            if e.op == "=~":
                return F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
            return {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[e.op](a, b)
        return self.arithmetic(e.op, a, ta, b, tb)

    def compare(self, op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
            return F.lit(None).cast("boolean")
        if entity(ta) and entity(ta) == entity(tb):
            a, b, ta, tb = a[ID], b[ID], T.LongType(), T.LongType()
        if not comparable(ta, tb):
            if op in ("=", "<>"):
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "<>"))
            return F.lit(None).cast("boolean")
        if isinstance(ta, (T.ArrayType, T.MapType)) and ta != tb:
            to = widened(ta, tb)
            a, b = a.cast(to), b.cast(to)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def member_of(self, a: Column, ta: T.DataType, b: Column, tb: T.DataType, right: Expr) -> Column:
        if isinstance(tb, T.NullType):
            return F.lit(None).cast("boolean")
        element = tb.elementType if isinstance(tb, T.ArrayType) else NULL
        if isinstance(element, T.NullType):  # an empty list, or nulls alone
            return F.when(F.size(b) == 0, F.lit(False))
        if entity(ta) and entity(element):
            return F.exists(b, lambda x: x[ID] == a[ID])
        if isinstance(ta, T.NullType):
            return F.when(F.size(b) == 0, F.lit(False))
        if not comparable(ta, element):
            return F.when(F.size(b) == 0, F.lit(False)).when(a.isNull() | F.exists(b, lambda x: x.isNull()), F.lit(None)).otherwise(F.lit(False))
        if isinstance(right, ListLit) and not isinstance(ta, T.ArrayType):
            return a.isin(*[self.column(x) for x in right.items])
        to = widened(ta, element)
        return F.when(F.size(b) == 0, F.lit(False)).otherwise(F.array_contains(b.cast(T.ArrayType(to)), a.cast(to)))

    def arithmetic(self, op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
        if op == "+" and (isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType)):
            if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
                to = widened(ta, tb)
                return F.concat(a.cast(to), b.cast(to))
            if isinstance(ta, T.ArrayType):
                to = widened(ta.elementType, tb)
                return F.concat(a.cast(T.ArrayType(to)), F.array(self.cast(b, tb, to)))
            to = widened(tb.elementType, ta)
            return F.concat(F.array(self.cast(a, ta, to)), b.cast(T.ArrayType(to)))
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
            return F.lit(None)
        if op == "+" and (isinstance(ta, T.StringType) or isinstance(tb, T.StringType)):
            return F.concat(S.to_string(a, ta), S.to_string(b, tb))
        if S.is_duration(tb) and isinstance(ta, S.TIMES) and op in "+-":
            return S.shifted(a, b, 1 if op == "+" else -1)
        if S.is_duration(ta) and isinstance(tb, S.TIMES) and op == "+":
            return S.shifted(b, a, 1)
        if S.is_duration(ta) and S.is_duration(tb) and op in "+-":
            return F.struct(*[(a[f.name] + b[f.name] if op == "+" else a[f.name] - b[f.name]).alias(f.name) for f in S.DURATION.fields])
        if isinstance(ta, S.TIMES) and isinstance(tb, S.TIMES) and op == "-":
            return S.between(a, b)
        if not (isinstance(ta, S.NUMERIC) and isinstance(tb, S.NUMERIC)):
            raise CypherError("TypeError", f"{op} of {ta.simpleString()} and {tb.simpleString()}")
        whole = isinstance(ta, S.INTEGRAL) and isinstance(tb, S.INTEGRAL)
        if whole:
            a, b = a.cast("long"), b.cast("long")
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        if op == "/":
            return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))) if whole else F.try_divide(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.try_mod(a, b)
        return a + b if op == "+" else a - b if op == "-" else a * b

    def _case(self, e: Case) -> Column:
        results = [self.typed(r) for _, r in e.whens] + ([self.typed(e.other)] if e.other is not None else [])
        kind: T.DataType = NULL
        for _, t in results:
            kind = widened(kind, t)
        out = None
        for (when, _), (c, t) in zip(e.whens, results, strict=False):
            test = self._binary(Binary("=", e.subject, when)) if e.subject is not None else self.boolean(when)
            value = self.cast(c, t, kind)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(self.cast(*results[-1], kind)) if e.other is not None else out

    # --- functions ---

    def _func(self, e: Func) -> Column:
        name, args = e.name, e.args
        if is_aggregate(e):
            raise CypherError("InvalidAggregation", f"{name} is not allowed here")
        b = self.binding(args[0]) if args else None
        if name == "exists":
            return self.column(args[0]).isNotNull() if not isinstance(args[0], Exists) else self.column(args[0])
        if name in ("id", "elementid", "labels", "type", "properties", "keys"):
            return self.entity_function(name, b, args)
        if name in ("nodes", "relationships", "rels"):
            if isinstance(b, PathOf):
                part = 0 if name == "nodes" else 1
                if b.parts:
                    return self.same_shape(b.parts[part::2])
                return F.col(b.nodes if part == 0 else b.rels)
            return F.lit(None)
        if name == "length" and isinstance(b, PathOf):
            return F.size(F.col(b.rels)).cast("long")
        typed = [self.typed(a) for a in args]
        if name not in S.REGISTRY:
            raise CypherError("UnknownFunction", name)
        if any(isinstance(t, T.NullType) for _, t in typed) and name not in ("coalesce", "valuetype"):
            return F.lit(None)
        try:
            return S.REGISTRY[name](*typed)
        except TypeError as problem:
            raise CypherError("Arity", f"{name}: {problem}") from None
        except ValueError as problem:
            raise CypherError("InvalidArgument", f"{name}: {problem}") from None

    def same_shape(self, parts: list[Any]) -> Column:
        """Entities of different tables as one array of structs."""
        kinds: dict[str, T.DataType] = {}
        columns = []
        for p in parts:
            c = p.whole()
            kind = self.frame.probe(c)
            for f in kind.fields:
                kinds[f.name] = widened(kinds.get(f.name, NULL), f.dataType)
            columns.append((c, kind.fieldNames()))
        if not columns:
            return F.array()
        rows = [F.struct(*[(c[n] if n in names else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]) for c, names in columns]
        return F.array(*rows)

    def entity_function(self, name: str, b: Any, args: list[Expr]) -> Column:
        if b is None or isinstance(b, (PathOf, Scalar)):
            c, kind = self.typed(args[0])
            what = entity(kind)
            if name == "keys" and isinstance(kind, T.MapType):
                return F.array_sort(F.map_keys(c))
            if name == "keys" and isinstance(kind, T.StructType):
                return self.present({f.name: c[f.name] for f in kind.fields if not f.name.startswith("__")}, c, every=not what)
            if name == "properties" and isinstance(kind, T.StructType) and not what:
                return c
            if not what:
                return F.lit(None)
            get = {"id": c[ID], "labels": c["__labels"] if what == "node" else F.lit(None), "type": c["__type"] if what == "edge" else F.lit(None)}
            if name in get:
                return get[name]
            if name == "elementid":
                return F.concat(F.lit(f"{'node' if what == 'node' else 'relationship'}:"), c[ID].cast("string"))
            return F.struct(*[c[f.name].alias(f.name) for f in kind.fields if not f.name.startswith("__")])
        there = F.col(b.id).isNotNull()
        if name == "id":
            return F.col(b.id)
        if name == "elementid":
            return F.concat(F.lit("node:" if isinstance(b, Node) else "relationship:"), F.col(b.id).cast("string"))
        if name == "labels":
            labels = F.col(b.labels) if isinstance(b, Node) and b.labels else F.array(*[F.lit(x) for x in sorted(getattr(b, "known", ()))]).cast("array<string>")
            return F.when(there, labels)
        if name == "type":
            return F.col(b.type) if isinstance(b, Edge) else F.lit(None)
        if name == "keys":
            return self.present({p: F.col(c) for p, c in b.props.items()}, F.col(b.id), every=False)
        return F.when(there, F.struct(*[F.col(c).alias(p) for p, c in sorted(b.props.items())])) if b.props else F.when(there, F.create_map().cast("map<string,string>"))

    @staticmethod
    def present(values: dict[str, Column], whole: Column, every: bool) -> Column:
        """Sorted names of the values that are not null (or of all)."""
        names = F.array(*[F.lit(p) if every else F.when(c.isNotNull(), F.lit(p)) for p, c in sorted(values.items())]).cast("array<string>")
        return F.when(whole.isNotNull(), F.filter(names, lambda x: x.isNotNull()))


def ends_of(b: Edge, name: str) -> str:
    return b.src if name == "startnode" else b.dst


__all__ = ["DST", "Expressions", "SRC", "ends_of", "free_vars", "has_aggregate", "is_aggregate"]
