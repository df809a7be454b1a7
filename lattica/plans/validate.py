"""What a query must not do, checked on its tree before anything is lowered."""

from __future__ import annotations

from lattica.plans.ast import CallQuery, Create, CypherError, Exists, Func, ListComp, Match, Merge, NodePat, PatternComp, Project, Query, Quantifier, Reduce, RelPat, SetClause, Unwind, Var, walk
from lattica.plans.expressions import has_aggregate, is_aggregate


def validate(query: Query) -> None:
    columns: list[str] | None = None
    for branch in query.branches:
        kinds: dict[str, str] = {}
        for k, c in enumerate(branch):
            if isinstance(c, CallQuery):
                if any(x.writes for b in c.query.branches for x in b):
                    raise CypherError("WriteInSubquery", "CALL {} must not write")
                if any(isinstance(x, Match) for x in branch[k + 1 :]):
                    raise CypherError("MatchAfterSubquery", "MATCH after CALL {}")
                validate(c.query)
            if isinstance(c, (Match, Create, Merge)):
                _kinds(c, kinds)
            if isinstance(c, Create):
                _create(c, set(), branch[:k])
            if isinstance(c, Merge):
                for r in c.path.rels:
                    if r.span is not None:
                        raise CypherError("MergeVariableLengthRelationship", ":".join(r.types))
                    if len(r.types) != 1:
                        raise CypherError("MergeRelationshipWithoutType", "MERGE")
            if isinstance(c, SetClause) and any(isinstance(x, (Exists, PatternComp)) for i in c.items if i.value is not None for x in walk(i.value)):
                raise CypherError("PatternInSetValue", "a pattern in SET")
            if isinstance(c, Match) and c.where is not None and has_aggregate(c.where):
                raise CypherError("InvalidAggregation", "an aggregate in WHERE")
            if isinstance(c, Unwind) and has_aggregate(c.source):
                raise CypherError("InvalidAggregation", "an aggregate in UNWIND")
            if isinstance(c, Project):
                _project(c)
                if not c.final:
                    keep = {i.expr.name: i.name for i in c.items if isinstance(i.expr, Var)}
                    kinds = kinds if c.star else {new: kinds[old] for old, new in keep.items() if old in kinds}
                elif not c.star:
                    names = [i.name for i in c.items]
                    if columns is not None and columns != names:
                        raise CypherError("UnionColumnMismatch", f"{columns} and {names}")
                    columns = names


def _kinds(c, kinds: dict[str, str]) -> None:
    """A variable is a node, a relationship or a path, and stays so."""
    for p in c.paths if hasattr(c, "paths") else [c.path]:
        for x in (*p.nodes, *p.rels):
            kind = "node" if isinstance(x, NodePat) else "relationship"
            if x.var and kinds.setdefault(x.var, kind) != kind:
                raise CypherError("VariableTypeConflict", x.var)
        if p.var:
            if p.var in kinds:
                raise CypherError("VariableTypeConflict", p.var)
            kinds[p.var] = "path"


def _create(c: Create, seen: set[str], before: list) -> None:
    for b in before:
        if isinstance(b, Project) and not b.star:
            seen = {i.name for i in b.items}
        else:
            seen |= {x.var for x in walk(b) if isinstance(x, (NodePat, RelPat)) and x.var}
    for p in c.paths:
        for r in p.rels:
            if r.span is not None:
                raise CypherError("CreateVariableLengthRelationship", ":".join(r.types))
            if len(r.types) != 1:
                raise CypherError("CreateRelationshipWithoutType", "CREATE")
            if r.direction == "both":
                raise CypherError("CreateUndirectedRelationship", r.types[0])
            if r.var and r.var in seen:
                raise CypherError("CreateOnBoundRelationship", r.var)
            if r.var:
                seen.add(r.var)
        for n in p.nodes:
            if n.var and n.var in seen and (n.labels or n.props is not None or not p.rels):
                raise CypherError("CreateOnBoundVariable", n.var)
            if n.var:
                seen.add(n.var)


def _project(c: Project) -> None:
    names = [i.name for i in c.items]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise CypherError("DuplicateColumn", ", ".join(sorted(twice)))
    grouped = any(has_aggregate(i.expr) for i in c.items)
    for i in c.items:
        for x in walk(i.expr):
            if is_aggregate(x) and any(is_aggregate(y) for a in x.args for y in walk(a)):
                raise CypherError("InvalidAggregation", "an aggregate within an aggregate")
            if isinstance(x, (ListComp, Quantifier, Reduce)) and any(has_aggregate(y) for y in (getattr(x, "where", None), getattr(x, "to", None), getattr(x, "step", None)) if y is not None):
                raise CypherError("InvalidAggregation", "an aggregate in a list expression")
    if not grouped and any(has_aggregate(e) for e, _ in c.order):
        raise CypherError("InvalidAggregation", "an aggregate in ORDER BY alone")
    if (grouped or c.distinct) and not c.star:
        known = set(names) | {x.name for i in c.items for x in walk(i.expr) if isinstance(x, Var)}
        for e, _ in c.order:
            for x in walk(e):
                if isinstance(x, Var) and x.name not in known and not any(isinstance(y, (ListComp, Quantifier, Reduce)) and x.name in (y.var, getattr(y, "acc", None)) for y in walk(e)):
                    raise CypherError("OrderByUndefinedVariable", x.name)
    for i in c.items:
        if isinstance(i.expr, Func) and i.expr.star and i.expr.name != "count":
            raise CypherError("Syntax", f"{i.expr.name}(*)")
