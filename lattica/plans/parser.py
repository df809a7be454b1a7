"""Text to syntax tree: a tokenizer and a recursive descent parser with precedence climbing."""

from __future__ import annotations

import re
from functools import lru_cache

from lattica.plans.ast import (
    CallProc, CallQuery, Case, Clause, Command, Create, CypherError, Delete, Exists, Expr, Foreach, Func, HasLabels, Index, IsNull, Item, ListComp, ListLit, Lit, MapLit, Match, Merge, NodePat, Param,
    Path, PatternComp, Project, Prop, Quantifier, Query, Reduce, RelPat, SetClause, SetItem, Slice, Unary, Unwind, Var, Binary,
)

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<float>(?:\d+\.\d+|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<hex>0[xX][0-9a-fA-F]+)|(?P<oct>0[oO][0-7]+)|(?P<int>\d+)
    |(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<quoted>`(?:``|[^`])*`)|(?P<name>[^\W\d]\w*)|(?P<param>\$\w+)
    |(?P<op><=|>=|<>|!=|=~|\+=|\.\.|[-+*/%^=<>(){}\[\],.:;|$])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
CLAUSE_STARTS = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "FOREACH", "CALL", "UNION", "ORDER", "SKIP", "LIMIT", "ON", "YIELD"}


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.toks: list[tuple[str, str, int, int]] = []
        k = 0
        while k < len(text):
            m = TOKEN.match(text, k)
            if not m:
                raise CypherError("Syntax", f"unexpected {text[k : k + 20]!r}")
            if m.lastgroup != "space":
                self.toks.append((m.lastgroup, m[0], m.start(), m.end()))
            k = m.end()
        self.toks.append(("end", "", len(text), len(text)))

    # --- tokens ---

    def peek(self, ahead: int = 0) -> tuple[str, str, int, int]:
        return self.toks[min(self.at + ahead, len(self.toks) - 1)]

    def is_op(self, *ops: str, ahead: int = 0) -> bool:
        kind, text, *_ = self.peek(ahead)
        return kind == "op" and text in ops

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, text, *_ = self.peek(ahead)
        return kind == "name" and text.upper() in words

    def op(self, *ops: str) -> str | None:
        if self.is_op(*ops):
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def word(self, *words: str) -> bool:
        """Take all of these words, or nothing."""
        if all(self.is_word(w, ahead=k) for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, what: str) -> None:
        if not (self.op(what) or self.word(what)):
            raise CypherError("Syntax", f"expected {what} at {self.text[self.peek()[2] :][:30]!r}")

    def name(self) -> str:
        kind, text, *_ = self.peek()
        if kind not in ("name", "quoted"):
            raise CypherError("Syntax", f"expected a name at {self.text[self.peek()[2] :][:30]!r}")
        self.at += 1
        return text[1:-1].replace("``", "`") if kind == "quoted" else text

    def integer(self) -> int:
        kind, text, *_ = self.peek()
        if kind != "int":
            raise CypherError("Syntax", f"expected a number at {text!r}")
        self.at += 1
        return int(text)

    # --- queries ---

    def query(self) -> Query:
        mode = "explain" if self.word("EXPLAIN") else "profile" if self.word("PROFILE") else ""
        q = self.union()
        self.op(";")
        if self.peek()[0] != "end":
            raise CypherError("Syntax", f"unexpected {self.text[self.peek()[2] :][:30]!r}")
        q.mode = mode
        return q

    def union(self) -> Query:
        branches, kinds = [self.clauses()], set()
        while self.word("UNION"):
            kinds.add(self.word("ALL"))
            branches.append(self.clauses())
        if len(kinds) > 1:
            raise CypherError("MixedUnionAndUnionAll", "UNION and UNION ALL in one query")
        return Query(branches, kinds == {True})

    def clauses(self) -> list[Clause]:
        out: list[Clause] = []
        while self.peek()[0] != "end" and not self.is_op(";", "}", ")") and not self.is_word("UNION"):
            out.append(self.clause())
        if not out:
            raise CypherError("Syntax", "an empty query")
        return out

    def clause(self) -> Clause:
        if c := self.command():
            return c
        if self.word("OPTIONAL", "MATCH"):
            return Match(self.paths(), self.where(), True)
        if self.word("MATCH"):
            return Match(self.paths(), self.where())
        if self.word("UNWIND"):
            e = self.expr()
            self.need("AS")
            return Unwind(e, self.name())
        if self.word("WITH"):
            return self.project(False)
        if self.word("RETURN"):
            return self.project(True)
        if self.word("CREATE"):
            return Create(self.paths())
        if self.word("MERGE"):
            path, on = self.path(), {"CREATE": [], "MATCH": []}
            while self.word("ON"):
                kind = "CREATE" if self.word("CREATE") else "MATCH"
                if kind == "MATCH":
                    self.need("MATCH")
                self.need("SET")
                on[kind] += self.set_items()
            return Merge(path, on["CREATE"], on["MATCH"])
        if self.word("SET"):
            return SetClause(self.set_items())
        if self.word("REMOVE"):
            items = []
            while True:
                var = self.name()
                if self.op("."):
                    items.append(SetItem(var, "drop_prop", self.name()))
                else:
                    items.append(SetItem(var, "drop_labels", labels=self.labels()))
                if not self.op(","):
                    return SetClause(items)
        if self.is_word("DELETE") or self.is_word("DETACH"):
            detach = self.word("DETACH")
            self.need("DELETE")
            exprs = [self.expr()]
            while self.op(","):
                exprs.append(self.expr())
            return Delete(exprs, detach)
        if self.word("FOREACH"):
            self.need("(")
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("|")
            body = self.clauses()
            self.need(")")
            return Foreach(var, source, body)
        if self.word("CALL"):
            return self.call()
        raise CypherError("Syntax", f"unexpected {self.text[self.peek()[2] :][:30]!r}")

    def where(self) -> Expr | None:
        return self.expr() if self.word("WHERE") else None

    def project(self, final: bool) -> Project:
        distinct, star, items = self.word("DISTINCT"), False, []
        if self.op("*"):
            star = True
        while (not star and not items) or self.op(","):
            low = self.peek()[2]
            e = self.expr()
            text = self.text[low : self.toks[self.at - 1][3]].strip()
            items.append(Item(e, self.name() if self.word("AS") else None, e.name if isinstance(e, Var) else text))
        order, skip, limit, where = [], None, None, None
        if self.word("ORDER", "BY"):
            while not order or self.op(","):
                e = self.expr()
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                order.append((e, not down))
        if self.word("SKIP"):
            skip = self.expr()
        if self.word("LIMIT"):
            limit = self.expr()
        if not final:
            where = self.where()
        return Project(items, star, distinct, order, skip, limit, where, final)

    def set_items(self) -> list[SetItem]:
        out = []
        while not out or self.op(","):
            var = self.name()
            if self.op("."):
                key = self.name()
                self.need("=")
                out.append(SetItem(var, "prop", key, self.expr()))
            elif self.op("="):
                out.append(SetItem(var, "replace", value=self.expr()))
            elif self.op("+="):
                out.append(SetItem(var, "merge", value=self.expr()))
            else:
                out.append(SetItem(var, "labels", labels=self.labels()))
        return out

    def call(self) -> Clause:
        if self.op("{"):
            q = self.union()
            self.need("}")
            return CallQuery(q)
        name = self.name()
        while self.op("."):
            name += "." + self.name()
        args: list[Expr] = []
        if self.op("("):
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
        yields = None
        if self.word("YIELD"):
            yields = []
            while not yields or self.op(","):
                field = self.name()
                yields.append((field, self.name() if self.word("AS") else field))
        return CallProc(name, args, yields, self.where())

    def command(self) -> Command | None:
        start = self.at
        if self.word("SHOW"):
            for words, kind in ((("INDEXES",), "show_indexes"), (("CONSTRAINTS",), "show_constraints"), (("HIERARCHY", "INDEXES"), "show_hierarchies"), (("VECTOR", "INDEXES"), "show_vectors")):
                if self.word(*words):
                    return Command(kind, {})
            raise CypherError("Syntax", "SHOW what?")
        if self.word("REBUILD", "HIERARCHY", "INDEX"):
            return Command("rebuild_hierarchy", {"name": self.name()})
        if self.word("DROP", "HIERARCHY", "INDEX"):
            return Command("drop_hierarchy", {"name": self.name()})
        if self.word("DROP", "INDEX"):
            self.word("ON")
            self.op(":")
            return Command("drop_index", self._label_props())
        if self.word("CREATE", "HIERARCHY", "INDEX"):
            name = self.name()
            self.need("ON")
            path = self.path()
            args = {"name": name, "types": path.rels[0].types, "reverse": path.rels[0].direction == "in", "measure": None, "aggregates": ["sum"]}
            if self.word("MEASURE"):
                label = self.name()
                self.need(".")
                args["measure"] = (label, self.name())
            if self.word("AGGREGATE"):
                args["aggregates"] = [self.name().lower()]
                while self.op(","):
                    args["aggregates"].append(self.name().lower())
            return Command("create_hierarchy", args)
        if self.word("CREATE", "VECTOR", "INDEX"):
            name = self.name()
            self.need("FOR")
            self.need("(")
            self.name()
            label = self.labels()[0]
            self.need(")")
            self.need("ON")
            self.need("(")
            self.name()
            self.need(".")
            prop = self.name()
            self.need(")")
            options = {"dimensions": 1536, "similarity": "cosine"}
            if self.word("OPTIONS"):
                m = self.primary()
                for k, v in m.items if isinstance(m, MapLit) else []:
                    if k not in options or not isinstance(v, Lit):
                        raise CypherError("InvalidOption", f"unknown vector index option {k}")
                    options[k] = v.value
            return Command("create_vector", {"name": name, "label": label, "prop": prop, **options})
        if self.word("CREATE", "CONSTRAINT"):
            if not self.is_word("ON", "FOR"):
                self.name()
            self.at += 1
            self.need("(")
            self.name()
            label = self.labels()[0]
            self.need(")")
            self.at += 1  # ASSERT, REQUIRE
            self.op("(")
            self.name()
            self.need(".")
            prop = self.name()
            self.op(")")
            self.need("IS")
            self.need("UNIQUE")
            return Command("create_constraint", {"label": label, "prop": prop})
        if self.word("CREATE", "INDEX"):
            if not self.is_word("ON", "FOR"):
                self.name()
            if self.word("FOR"):
                self.need("(")
                self.name()
                label = self.labels()[0]
                self.need(")")
                self.need("ON")
                self.need("(")
                props = []
                while not props or self.op(","):
                    self.name()
                    self.need(".")
                    props.append(self.name())
                self.need(")")
                return Command("create_index", {"label": label, "props": props})
            self.need("ON")
            self.op(":")
            return Command("create_index", self._label_props())
        self.at = start
        return None

    def _label_props(self) -> dict:
        label, props = self.name(), []
        self.need("(")
        while not props or self.op(","):
            props.append(self.name())
        self.need(")")
        return {"label": label, "props": props}

    # --- patterns ---

    def paths(self) -> list[Path]:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return out

    def path(self) -> Path:
        var = None
        if self.peek()[0] in ("name", "quoted") and self.is_op("=", ahead=1):
            var = self.name()
            self.need("=")
        kind = ""
        if self.is_word("SHORTESTPATH", "ALLSHORTESTPATHS") and self.is_op("(", ahead=1):
            kind = "shortest" if self.is_word("SHORTESTPATH") else "all"
            self.at += 2
        nodes, rels = [self.node()], []
        while self.is_op("-", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        if kind:
            self.need(")")
        return Path(var, nodes, rels, kind)

    def labels(self) -> list[str]:
        out = []
        while self.op(":"):
            out.append(self.name())
        if not out:
            raise CypherError("Syntax", f"expected a label at {self.text[self.peek()[2] :][:30]!r}")
        return out

    def node(self) -> NodePat:
        self.need("(")
        var = self.name() if self.peek()[0] in ("name", "quoted") else None
        labels = self.labels() if self.is_op(":") else []
        props = self.primary() if self.is_op("{") or self.peek()[0] == "param" else None
        self.need(")")
        return NodePat(var, labels, props)

    def rel(self) -> RelPat:
        left = bool(self.op("<"))
        self.need("-")
        var, types, props, span = None, [], None, None
        if self.op("["):
            var = self.name() if self.peek()[0] in ("name", "quoted") else None
            if self.op(":"):
                types.append(self.name())
                while self.op("|"):
                    self.op(":")
                    types.append(self.name())
            if self.op("*"):
                low = self.integer() if self.peek()[0] == "int" else None
                if self.op(".."):
                    span = (1 if low is None else low, self.integer() if self.peek()[0] == "int" else None)
                else:
                    span = (1, None) if low is None else (low, low)
            if self.is_op("{") or self.peek()[0] == "param":
                props = self.primary()
            self.need("]")
        self.need("-")
        right = bool(self.op(">"))
        return RelPat(var, types, "in" if left and not right else "out" if right and not left else "both", props, span)

    # --- expressions ---

    def expr(self) -> Expr:
        return self.disjunction()

    def _left(self, words: str, below) -> Expr:
        e = below()
        while self.word(words):
            e = Binary(words, e, below())
        return e

    def disjunction(self) -> Expr:
        return self._left("OR", lambda: self._left("XOR", lambda: self._left("AND", self.negation)))

    def negation(self) -> Expr:
        return Unary("NOT", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> Expr:
        e, chain, last = self.additive(), [], None
        while True:
            if o := self.op("=", "<>", "!=", "<", "<=", ">", ">="):
                right = self.additive()
                o = "<>" if o == "!=" else o
                if last is not None and (o in ("=", "<>")) != (last in ("=", "<>")):
                    raise CypherError("Syntax", "mixed chain of comparisons")
                chain.append(Binary(o, e, right))
                e, last = right, o
                continue
            left = self._and(chain) if chain else e
            if self.op("=~"):
                e, chain = Binary("=~", left, self.additive()), []
            elif self.word("IN"):
                e, chain = Binary("IN", left, self.additive()), []
            elif self.word("STARTS", "WITH"):
                e, chain = Binary("STARTS", left, self.additive()), []
            elif self.word("ENDS", "WITH"):
                e, chain = Binary("ENDS", left, self.additive()), []
            elif self.word("CONTAINS"):
                e, chain = Binary("CONTAINS", left, self.additive()), []
            elif self.word("IS", "NULL"):
                e, chain = IsNull(left, False), []
            elif self.word("IS", "NOT", "NULL"):
                e, chain = IsNull(left, True), []
            else:
                return left

    @staticmethod
    def _and(parts: list[Expr]) -> Expr:
        e = parts[0]
        for p in parts[1:]:
            e = Binary("AND", e, p)
        return e

    def additive(self) -> Expr:
        e = self.multiplicative()
        while o := self.op("+", "-"):
            e = Binary(o, e, self.multiplicative())
        return e

    def multiplicative(self) -> Expr:
        e = self.power()
        while o := self.op("*", "/", "%"):
            e = Binary(o, e, self.power())
        return e

    def power(self) -> Expr:
        e = self.unary()
        return Binary("^", e, self.power()) if self.op("^") else e

    def unary(self) -> Expr:
        if self.op("-"):
            if self.peek()[0] == "int":
                return self.postfix(Lit(self._int(-int(self.toks[self.at][1]), 1)))
            e = self.unary()
            return Lit(-e.value) if isinstance(e, Lit) and isinstance(e.value, float) else Unary("-", e)
        if self.op("+"):
            return self.unary()
        return self.postfix(self.primary())

    def _int(self, value: int, take: int = 0) -> int:
        self.at += take
        if not -(1 << 63) <= value < 1 << 63:
            raise CypherError("Syntax", f"integer {value} out of range")
        return value

    def postfix(self, e: Expr) -> Expr:
        while True:
            if self.is_op(".") and self.peek(1)[0] in ("name", "quoted"):
                self.at += 1
                e = Prop(e, self.name())
            elif self.op("["):
                if self.op(".."):
                    high = None if self.is_op("]") else self.expr()
                    e = Slice(e, None, high)
                else:
                    low = self.expr()
                    if self.op(".."):
                        e = Slice(e, low, None if self.is_op("]") else self.expr())
                    else:
                        e = Index(e, low)
                self.need("]")
            elif self.is_op(":") and isinstance(e, (Var, Prop)) and self.peek(1)[0] in ("name", "quoted"):
                e = HasLabels(e, self.labels())
            else:
                return e

    def primary(self) -> Expr:
        kind, text, *_ = self.peek()
        if kind in ("int", "hex", "oct", "float"):
            self.at += 1
            return Lit(float(text) if kind == "float" else self._int(int(text, {"int": 10, "hex": 16, "oct": 8}[kind])))
        if kind == "str":
            self.at += 1
            return Lit(re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "param":
            self.at += 1
            return Param(text[1:])
        if self.op("["):
            return self.bracket()
        if self.op("{"):
            items = []
            while not self.op("}"):
                key = self.toks[self.at][1][1:-1] if self.peek()[0] == "str" else None
                if key is None:
                    key = self.name()
                else:
                    self.at += 1
                self.need(":")
                items.append((key, self.expr()))
                self.op(",")
            return MapLit(items)
        if self.is_op("("):
            start = self.at
            try:
                path = self.path()
                if path.rels:
                    return Exists([path], None)
            except CypherError:
                pass
            self.at = start + 1
            e = self.expr()
            self.need(")")
            return e
        if kind == "quoted":
            return Var(self.name())
        if kind != "name":
            raise CypherError("Syntax", f"unexpected {self.text[self.peek()[2] :][:30]!r}")
        upper = text.upper()
        if upper in ("TRUE", "FALSE", "NULL") and not self.is_op("(", ahead=1):
            self.at += 1
            return Lit({"TRUE": True, "FALSE": False, "NULL": None}[upper])
        if upper == "CASE":
            return self.case()
        if upper == "EXISTS" and self.is_op("{", ahead=1):
            self.at += 2
            self.word("MATCH")
            out = Exists(self.paths(), self.where())
            self.need("}")
            return out
        if upper in ("ALL", "ANY", "NONE", "SINGLE") and self.is_op("(", ahead=1) and self.is_word("IN", ahead=3):
            self.at += 2
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("WHERE")
            out = Quantifier(upper.lower(), var, source, self.expr())
            self.need(")")
            return out
        if upper == "REDUCE" and self.is_op("(", ahead=1):
            self.at += 2
            acc = self.name()
            self.need("=")
            init = self.expr()
            self.need(",")
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("|")
            out = Reduce(acc, init, var, source, self.expr())
            self.need(")")
            return out
        name = self.name()
        start = self.at
        while self.op("."):  # names of functions may hold dots
            if self.peek()[0] != "name":
                break
            self.name()
        if self.is_op("(") and self.at > start:
            name = self.text[self.toks[start - 1][2] : self.toks[self.at - 1][3]]
        else:
            self.at = start
        if self.op("("):
            if self.op("*"):
                self.need(")")
                return Func(name.lower(), [], star=True)
            distinct, args = self.word("DISTINCT"), []
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
            return Func(name.lower(), args, distinct)
        return Var(name)

    def case(self) -> Case:
        self.need("CASE")
        subject = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.word("WHEN"):
            w = self.expr()
            self.need("THEN")
            whens.append((w, self.expr()))
        other = self.expr() if self.word("ELSE") else None
        self.need("END")
        return Case(subject, whens, other)

    def bracket(self) -> Expr:
        start = self.at
        if self.peek()[0] in ("name", "quoted") and self.is_word("IN", ahead=1):
            var = self.name()
            self.need("IN")
            source = self.expr()
            where = self.where()
            to = self.expr() if self.op("|") else None
            if self.op("]"):
                return ListComp(var, source, where, to)
            self.at = start
        try:
            path = self.path()
            where = self.where()
            if path.rels and self.op("|"):
                to = self.expr()
                self.need("]")
                return PatternComp(path, where, to)
        except CypherError:
            pass
        self.at = start
        items = []
        while not self.op("]"):
            items.append(self.expr())
            if not self.is_op("]"):
                self.need(",")
        return ListLit(items)


@lru_cache(maxsize=256)
def parse(text: str) -> Query:
    """The tree of a query; trees are never changed, so they are shared."""
    return Parser(text).query()
