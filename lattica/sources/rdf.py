"""RDF triples as a DataFrame: N-Triples in and out, Turtle in, pattern queries, conversion to a graph."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import DST, ID, SRC, EdgeTable, NodeTable, PropertyGraph
from lattica.plans.ast import CypherError

#: subject, predicate, object term, then optional graph term
LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "owl": "http://www.w3.org/2002/07/owl#",
    "foaf": "http://xmlns.com/foaf/0.1/", "dc": "http://purl.org/dc/elements/1.1/",
}
TYPE = PREFIXES["rdf"] + "type"
#: Relationship types that a graph can be made of.
MOST_PREDICATES = 10_000


def term(c: Column) -> Column:
    """A term as struct(kind, value, lang, datatype)."""
    iri, blank = c.startswith("<"), c.startswith("_:")
    quoted = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = quoted
    for escaped, raw in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r'\\"', '"'), (r"\\\\", r"\\")):
        plain = F.regexp_replace(plain, escaped, raw)
    lang, datatype = F.regexp_extract(c, r"@([A-Za-z0-9-]+)$", 1), F.regexp_extract(c, r"\^\^<([^>]*)>$", 1)
    literal = ~iri & ~blank
    return F.struct(
        F.when(iri, "iri").when(blank, "blank").otherwise("literal").alias("kind"),
        F.when(iri, F.regexp_extract(c, r"^<([^>]*)>$", 1)).when(blank, F.substring(c, 3, 2**31 - 1)).otherwise(plain).alias("value"),
        F.when(literal & (lang != ""), lang).alias("lang"),
        F.when(literal & (datatype != ""), datatype).alias("datatype"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g) of N-Triples or N-Quads; comments and blank lines are skipped, other lines that don't parse are an error."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = lines.select("value", *[F.regexp_extract("value", LINE, k).alias(n) for k, n in enumerate("spog", 1)])
    checked = F.when(F.col("s") == "", F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))).otherwise(F.col("s"))
    return parts.select(term(checked).alias("s"), term(F.col("p")).alias("p"), term(F.col("o")).alias("o"), F.when(F.col("g") != "", F.regexp_replace("g", "[<>]", "")).alias("g"))


def written(t: Column) -> Column:
    value = t["value"]
    for raw, escaped in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\t", "\\\\t"), ("\r", "\\\\r")):
        value = F.regexp_replace(value, raw, escaped)
    literal = F.concat(F.lit('"'), value, F.lit('"'), F.coalesce(F.concat(F.lit("@"), t["lang"]), F.concat(F.lit("^^<"), t["datatype"], F.lit(">")), F.lit("")))
    return F.when(t["kind"] == "iri", F.concat(F.lit("<"), t["value"], F.lit(">"))).when(t["kind"] == "blank", F.concat(F.lit("_:"), t["value"])).otherwise(literal)


def write_ntriples(triples: DataFrame, path: str) -> None:
    graph = F.coalesce(F.concat(F.lit(" <"), F.col("g"), F.lit(">")), F.lit(""))
    triples.select(F.concat(written(F.col("s")), F.lit(" "), written(F.col("p")), F.lit(" "), written(F.col("o")), graph, F.lit(" .")).alias("value")).write.mode("overwrite").text(path)


def expand(name: str, prefixes: dict[str, str] | None = None) -> str:
    """A prefixed name as an IRI."""
    head, colon, tail = name.partition(":")
    known = PREFIXES | (prefixes or {})
    return known[head] + tail if colon and head in known else name


def pattern(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """The triples that agree with the given terms; None stands for any."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name)["value"] == expand(value))
    return triples if g is None else triples.where(F.col("g") == expand(g))


def to_graph(triples: DataFrame) -> PropertyGraph:
    """Resources as nodes (``iri``, ``rdf_type`` for rdf:type), literals as their properties, links between resources as relationships.

    Properties and relationships have the predicate's local name, or the whole predicate where several share one. A property holds
    the least of several literals of a predicate.
    """
    local = F.regexp_extract(F.col("p")["value"], r"([^/#]+)$", 1)
    key = lambda c: F.xxhash64(c["kind"], c["value"])
    used = triples.where(F.col("p")["value"] != TYPE).groupBy((F.col("o")["kind"] == "literal").alias("literal"), F.col("p")["value"].alias("iri")).agg(F.first(local).alias("name"))
    known = sorted(tuple(r) for r in used.limit(MOST_PREDICATES + 1).collect())
    if len(known) > MOST_PREDICATES:
        raise CypherError("TooManyPredicates", f"each of them is a table or a column; at most {MOST_PREDICATES}")
    times = Counter((literal, name) for literal, _, name in known)
    names = {(literal, iri): iri if times[literal, name] > 1 or not name or (literal and name in ("iri", "rdf_type")) else name for literal, iri, name in known}
    resources = triples.select(F.col("s").alias("r")).union(triples.where("o.kind <> 'literal'").select("o")).distinct()
    kinds = triples.where(F.col("p")["value"] == TYPE).groupBy(key(F.col("s")).alias("k")).agg(F.array_sort(F.collect_set(F.col("o")["value"])).alias("rdf_type"))
    nodes = resources.select(key(F.col("r")).alias(ID), F.col("r")["value"].alias("iri")).dropDuplicates([ID])
    nodes = nodes.join(kinds, F.col(ID) == F.col("k"), "left").drop("k")
    if columns := [F.min(F.when(F.col("p")["value"] == iri, F.col("o")["value"])).alias(names[True, iri]) for literal, iri, _ in known if literal]:
        values = triples.where("o.kind = 'literal'").groupBy(key(F.col("s")).alias("k")).agg(*columns)
        nodes = nodes.join(values, F.col(ID) == F.col("k"), "left").drop("k")
    links = triples.where((F.col("o")["kind"] != "literal") & (F.col("p")["value"] != TYPE)).distinct()
    edges = tuple(
        EdgeTable(names[False, iri], links.where(F.col("p")["value"] == iri).select(F.xxhash64("s.value", "p.value", "o.value").alias(ID), key(F.col("s")).alias(SRC), key(F.col("o")).alias(DST))) for literal, iri, _ in known if not literal
    )
    return PropertyGraph(triples.sparkSession, (NodeTable(frozenset(["Resource"]), nodes),), edges)


#: Tokens of Turtle; literals and IRIs come before comments, so that a # within them is none.
TURTLE = re.compile(
    r"""(?P<iri><[^<>"{}|^`\s]*>)|(?P<text>\"""(?:[^"\\]|\\.|"(?!""))*\"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<comment>\#[^\n]*)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"""
    r"""|(?P<blank>_:[\w\-]+(?:\.[\w\-]+)*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+|[+-]?\d*\.\d+|[+-]?\d+)|(?P<name>[\w\-]*(?:\.[\w\-]+)*:(?:[\w\-:%]|\\.|\.(?=[\w\-:%\\]))*)|(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[.;,\[\]()])|(?P<space>\s+)""",
    re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class _Turtle:
    """Reads one Turtle document into rows (s, p, o, g) of terms (kind, value, lang, datatype)."""

    def __init__(self, text: str):
        self.tokens, self.rows, self.at, self.blanks = [], [], 0, 0
        self.prefixes, self.base = dict(PREFIXES), ""
        at = 0
        while at < len(text):
            m = TURTLE.match(text, at)
            if m is None:
                raise CypherError("Syntax", f"not Turtle: {text[at : at + 30]!r}")
            if m.lastgroup not in ("comment", "space"):
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, got = self.peek()
        if kind == "end" or (value is not None and got != value):
            raise CypherError("Syntax", f"{value or 'more'} expected, {got or 'the end'} found")
        self.at += 1
        return kind, got

    def document(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, got = self.peek()
            word = got.lower().lstrip("@")
            if kind in ("lang", "word") and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    name = self.take()[1].removesuffix(":")
                    self.prefixes[name] = self.iri(self.take()[1])
                else:
                    self.base = self.iri(self.take()[1])
                if got.startswith("@"):
                    self.take(".")
                continue
            alone = got == "["
            s = self.term()
            if not (alone and self.peek()[1] == "."):
                self.statements(s)
            self.take(".")
        return self.rows

    def statements(self, s: tuple) -> None:
        """Predicates and objects of a subject, up to what ends them."""
        while self.peek()[1] not in (".", "]"):
            p = ("iri", TYPE, None, None) if self.peek() == ("word", "a") else None
            if p:
                self.take()
            else:
                p = self.term()
            while True:
                self.rows.append((s, p, self.term(), None))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] not in (".", "]") and self.tokens[self.at - 1][1] != ";":
                raise CypherError("Syntax", f"; or . expected, {self.peek()[1]} found")

    def iri(self, token: str) -> str:
        raw = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), token[1:-1])
        return urljoin(self.base, raw) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw) else raw

    def fresh(self) -> tuple:
        self.blanks += 1
        return ("blank", f"genid{self.blanks}", None, None)

    def term(self) -> tuple:
        kind, got = self.take()
        if kind == "iri":
            return ("iri", self.iri(got), None, None)
        if kind == "blank":
            return ("blank", got[2:], None, None)
        if kind == "name":
            head, _, tail = got.partition(":")
            if head not in self.prefixes:
                raise CypherError("Syntax", f"unknown prefix {head}:")
            return ("iri", self.prefixes[head] + re.sub(r"\\(.)", r"\1", tail), None, None)
        if kind == "text":
            width = 3 if got[:3] in ('"""', "\'\'\'") else 1
            value = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), got[width:-width], flags=re.S)
            if self.peek()[0] == "lang":
                return ("literal", value, self.take()[1][1:], None)
            if self.peek()[1] == "^^":
                self.take()
                return ("literal", value, None, self.term()[1])
            return ("literal", value, None, None)
        if kind == "number":
            return ("literal", got, None, PREFIXES["xsd"] + ("double" if "e" in got.lower() else "decimal" if "." in got else "integer"))
        if kind == "word" and got in ("true", "false"):
            return ("literal", got, None, PREFIXES["xsd"] + "boolean")
        if got == "[":
            s = self.fresh()
            self.statements(s)
            self.take("]")
            return s
        if got == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take()
            rdf = lambda name: ("iri", PREFIXES["rdf"] + name, None, None)
            cells = [self.fresh() for _ in items] + [rdf("nil")]
            for k, item in enumerate(items):
                self.rows += [(cells[k], rdf("first"), item, None), (cells[k], rdf("rest"), cells[k + 1], None)]
            return cells[0]
        raise CypherError("Syntax", f"a term expected, {got} found")


def read_turtle(spark: SparkSession, text: str) -> DataFrame:
    """(s, p, o, g) of a Turtle document: prefixes, base, ``a``, lists by ``;`` and ``,``, blank nodes with properties, collections, literals of all forms.

    A document's prefixes and brackets reach across lines, so it is parsed as a whole, on the driver; large data come as N-Triples.
    """
    t = "struct<kind:string,value:string,lang:string,datatype:string>"
    return spark.createDataFrame(_Turtle(text).document(), f"s {t}, p {t}, o {t}, g string")


def _by_subject(triples: DataFrame) -> DataFrame:
    """(subject, pairs): the predicates and objects of each subject in a fixed order."""
    pair = F.struct(written(F.col("p")).alias("p"), written(F.col("o")).alias("o"), F.col("p")["value"].alias("iri"), F.col("o").alias("term"))
    return triples.groupBy(written(F.col("s")).alias("subject"), F.col("s").alias("s")).agg(F.array_sort(F.collect_set(pair)).alias("pairs"))


def write_turtle(triples: DataFrame, path: str) -> None:
    """One statement per subject, its predicates separated by semicolons."""
    lines = F.array_join(F.transform("pairs", lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ; ")
    _by_subject(triples).select(F.concat(F.col("subject"), F.lit(" "), lines, F.lit(" .")).alias("value")).write.mode("overwrite").text(path)


def write_jsonld(triples: DataFrame, path: str) -> None:
    """One JSON-LD node object per line and subject."""
    def value(t: Column) -> Column:
        ref = F.to_json(F.struct(F.when(t["kind"] == "blank", F.concat(F.lit("_:"), t["value"])).otherwise(t["value"]).alias("@id")))
        plain = F.to_json(F.struct(t["value"].alias("@value"), t["lang"].alias("@language"), t["datatype"].alias("@type")))
        return F.when(t["kind"] == "literal", plain).otherwise(ref)

    keys = F.array_distinct(F.transform("pairs", lambda x: x["iri"]))
    members = F.transform(keys, lambda k: F.concat(F.to_json(F.array(k)), F.lit(":["), F.array_join(F.transform(F.filter("pairs", lambda x: x["iri"] == k), lambda x: value(x["term"])), ","), F.lit("]")))
    members = F.transform(members, lambda m: F.regexp_replace(m, r'^\["(.*?)"\]:', r'"$1":'))
    name = F.when(F.col("s")["kind"] == "blank", F.concat(F.lit("_:"), F.col("s")["value"])).otherwise(F.col("s")["value"])
    start = F.regexp_replace(F.to_json(F.struct(name.alias("@id"))), r"\}$", "")
    _by_subject(triples).select(F.concat(start, F.lit(","), F.array_join(members, ","), F.lit("}")).alias("value")).write.mode("overwrite").text(path)
