"""Semantics of the query language on tiny graphs."""

import pytest

from lattica.graph import CypherError, Graph, Graphs
from lattica.model import PropertyGraph
from lattica.operators import vector


def build(spark, nodes, edges):
    return Graph(PropertyGraph.build(spark, nodes, edges))


@pytest.fixture(scope="module")
def people(spark):
    rows = [("Alice", "Eng", 100, "Rome"), ("Bob", "Eng", 90, "Oslo"), ("Carol", "Ops", 80, "Rome"), ("Dave", "Ops", 80, "Oslo"), ("Eve", "Eng", 120, "Rome"), ("Frank", None, None, "Oslo")]
    nodes = [{"id": k, "labels": ["Person"], "name": n, "dept": d, "salary": s, "city": c} for k, (n, d, s, c) in enumerate(rows)]
    edges = [{"src": a, "dst": b, "type": "KNOWS", "id": k, "since": 2000 + k} for k, (a, b) in enumerate([(0, 1), (0, 2), (1, 0), (2, 0), (3, 4), (4, 3)])]
    return build(spark, nodes, edges)


@pytest.fixture(scope="module")
def line(spark):
    names = "ABCDXY"
    nodes = [{"id": k, "labels": ["N"], "name": n} for k, n in enumerate(names)]
    pairs = [("A", "B", "LINK"), ("B", "C", "LINK"), ("C", "D", "LINK"), ("D", "A", "BACK"), ("A", "X", "OTHER"), ("X", "Y", "OTHER")]
    return build(spark, nodes, [{"id": k, "src": names.index(a), "dst": names.index(b), "type": t} for k, (a, b, t) in enumerate(pairs)])


@pytest.fixture(scope="module")
def diamond(spark):
    names = "ABCDEF"
    pairs = [("A", "B"), ("B", "D"), ("A", "C"), ("C", "D"), ("A", "E"), ("E", "F"), ("F", "D")]
    return build(spark, [{"id": k, "labels": ["N"], "name": n} for k, n in enumerate(names)], [{"id": k, "src": names.index(a), "dst": names.index(b), "type": "LINK"} for k, (a, b) in enumerate(pairs)])


def rows(graph, text, **params):
    return [tuple(r) for r in graph.cypher(text, params).collect()]


def bag(graph, text, **params):
    return sorted(rows(graph, text, **params), key=str)


def test_projection_names_and_nulls(people):
    df = people.read("MATCH (p:Person) WHERE p.name = 'Frank' RETURN p.name, p.salary * 2 AS s, p.dept IS NULL, count(*)")
    assert df.columns == ["p.name", "s", "p.dept IS NULL", "count(*)"] and [tuple(r) for r in df.collect()] == [("Frank", None, True, 1)]


def test_null_comparisons_drop_rows(people):
    assert bag(people, "MATCH (p:Person) WHERE p.salary > 0 RETURN count(p)") == [(5,)]
    assert bag(people, "MATCH (p:Person) WHERE NOT p.salary > 0 RETURN count(p)") == [(0,)]
    assert bag(people, "MATCH (p:Person) WHERE p.salary <> 100 RETURN count(p)") == [(4,)]
    assert rows(people, "RETURN 'a' < 1 AS x, 'a' = 1 AS y, null = null AS z, 1 = 1.0 AS w, [1] IN [[1], [2]] AS v") == [(None, False, None, True, True)]


def test_in_is_three_valued(people):
    assert rows(people, "RETURN 4 IN [1, null, 3] AS a, 1 IN [1, null] AS b, null IN [] AS c, 1 IN [] AS d, null IN [1] AS e, 2 IN [1.0, 2.0] AS f") == [(None, True, False, False, None, True)]


def test_order_by_nulls_last_and_first(people):
    assert [r[0] for r in rows(people, "MATCH (p:Person) RETURN p.name ORDER BY p.salary, p.name")] == ["Carol", "Dave", "Bob", "Alice", "Eve", "Frank"]
    assert [r[0] for r in rows(people, "MATCH (p:Person) RETURN p.name AS n ORDER BY p.salary DESC, n SKIP 1 LIMIT 2")] == ["Eve", "Alice"]


def test_aggregates(people):
    assert bag(people, "MATCH (p:Person) RETURN p.dept AS d, count(p.salary) AS n, sum(p.salary) AS s, min(p.name) AS m") == [("Eng", 3, 310, "Alice"), ("Ops", 2, 160, "Carol"), (None, 0, 0, "Frank")]
    assert rows(people, "MATCH (p:Person) RETURN avg(p.salary) AS a, count(DISTINCT p.salary) AS d, collect(DISTINCT p.dept) AS c") == [(94.0, 4, ["Eng", "Ops"])]
    assert rows(people, "UNWIND range(1, 10) AS x RETURN percentileCont(x, 0.5) AS a, percentileDisc(x, 0.5) AS b, stDevP(x * 0 + 2) AS c") == [(5.5, 5, 0.0)]
    assert rows(people, "UNWIND [2, 4, 4, 4, 5, 5, 7, 9] AS x RETURN stDevP(x) AS s, round(sum(x) / count(*)) AS m") == [(2.0, 5)]
    assert rows(people, "MATCH (p:Nobody) RETURN count(*) AS n, sum(p.x) AS s, collect(p.x) AS c") == [(0, 0, [])]


def test_grouping_by_entity_and_having(people):
    assert bag(people, "MATCH (p:Person)-[:KNOWS]->(q) WITH p, count(q) AS n WHERE n > 1 RETURN p.name AS name, n") == [("Alice", 2)]
    assert bag(people, "MATCH (p:Person)-[:KNOWS]->(q) WITH q, collect(p.name) AS ps RETURN q.name AS name, size(ps) AS n") == [("Alice", 2), ("Bob", 1), ("Carol", 1), ("Dave", 1), ("Eve", 1)]


def test_distinct(people):
    assert [r[0] for r in rows(people, "MATCH (p:Person) RETURN DISTINCT p.city AS c ORDER BY c")] == ["Oslo", "Rome"]
    assert rows(people, "MATCH (a)-[:KNOWS]-(b) RETURN count(DISTINCT a) AS n, count(a) AS m") == [(5, 12)]


def test_undirected_and_isomorphism(people):
    assert rows(people, "MATCH (a:Person {name: 'Alice'})-[r]-(b) RETURN count(r) AS n") == [(4,)]
    assert rows(people, "MATCH (a:Person {name: 'Alice'})-[r1:KNOWS]->(b)-[r2:KNOWS]->(c) RETURN count(*) AS n") == [(2,)]
    assert rows(people, "MATCH (a)-[r1]-(b)-[r2]-(a) WHERE a.name = 'Dave' RETURN count(*) AS n") == [(2,)]  # the same relationship isn't used twice
    assert rows(people, "MATCH (a:Person {name: 'Dave'})-[r1]->(b) MATCH (a)-[r2]->(c) RETURN count(*) AS n") == [(1,)]  # it is in two clauses


def test_self_reference(spark):
    g = build(spark, [{"id": 0, "labels": ["N"]}, {"id": 1, "labels": ["N"]}], [{"src": 0, "dst": 0, "type": "R"}, {"src": 0, "dst": 1, "type": "R"}])
    assert rows(g, "MATCH (a)-[:R]->(a) RETURN id(a) AS a") == [(0,)]
    assert rows(g, "MATCH (a)-[r:R]-(b) RETURN count(r) AS n") == [(3,)]


def test_optional_match(people):
    assert bag(people, "MATCH (p:Person) OPTIONAL MATCH (p)-[:KNOWS]->(q) WHERE q.city = 'Rome' RETURN p.name AS p, count(q) AS n") == [("Alice", 1), ("Bob", 1), ("Carol", 1), ("Dave", 1), ("Eve", 0), ("Frank", 0)]
    assert rows(people, "OPTIONAL MATCH (x:Nobody) RETURN x.name AS n, x IS NULL AS z") == [(None, True)]
    assert bag(people, "MATCH (p:Person {name: 'Frank'}) OPTIONAL MATCH (p)-[r:KNOWS]->(q)-[:KNOWS]->(z) RETURN r, q, z.name") == [(None, None, None)]
    assert rows(people, "MATCH (p:Person) OPTIONAL MATCH (n:Nobody) RETURN count(p) AS a, count(n) AS b") == [(6, 0)]


def test_exists_partitions(people):
    yes = bag(people, "MATCH (p:Person) WHERE EXISTS { MATCH (p)-[:KNOWS]->(q:Person)-[:KNOWS]->(x) WHERE q.city <> p.city AND x.city = p.city } RETURN p.name")
    no = bag(people, "MATCH (p:Person) WHERE NOT EXISTS { MATCH (p)-[:KNOWS]->(q:Person)-[:KNOWS]->(x) WHERE q.city <> p.city AND x.city = p.city } RETURN p.name")
    assert len(yes) + len(no) == 6 and ("Alice",) in yes and ("Frank",) in no
    assert bag(people, "MATCH (p:Person) WHERE (p)-[:KNOWS]->({name: 'Bob'}) OR p.name = 'Frank' RETURN p.name") == [("Alice",), ("Frank",)]
    assert rows(people, "MATCH (p:Person {name: 'Eve'}) RETURN exists((p)-[:KNOWS]->()) AS a, EXISTS { (p)<-[:NOPE]-() } AS b") == [(True, False)]


def test_pattern_comprehension(people):
    assert bag(people, "MATCH (p:Person) RETURN p.name AS p, [(p)-[:KNOWS]->(q) WHERE q.salary > 85 | q.name] AS l") == [("Alice", ["Bob"]), ("Bob", ["Alice"]), ("Carol", ["Alice"]), ("Dave", ["Eve"]), ("Eve", []), ("Frank", [])]


def test_variable_length(line):
    reach = lambda q: "".join(sorted(r[0] for r in rows(line, f"MATCH (a:N {{name: 'A'}})-[{q}]->(b) RETURN b.name")))
    assert reach(":LINK*") == "BCD" and reach(":LINK*2") == "C" and reach(":LINK*2..3") == "CD" and reach(":LINK*0..1") == "AB" and reach("*1..2") == "BCXY"
    assert reach(":LINK|BACK*") == "BCD"  # a cycle doesn't bring the source back
    assert "".join(sorted(r[0] for r in rows(line, "MATCH (b)-[:LINK*]->(d:N {name: 'D'}) RETURN b.name"))) == "ABC"
    assert rows(line, "MATCH p = (a:N {name: 'A'})-[r:LINK*3]->(d) RETURN length(p) AS l, [x IN nodes(p) | x.name] AS n, size(r) AS s, [x IN r | type(x)] AS t") == [(3, ["A", "B", "C", "D"], 3, ["LINK"] * 3)]
    assert rows(line, "MATCH (a:N {name: 'A'}), (d:N {name: 'D'}) MATCH (a)-[:LINK*]->(d) RETURN count(*) AS n") == [(1,)]


def test_named_paths(line):
    assert rows(line, "MATCH p = (a:N {name: 'A'})-[:OTHER]->(x)-[:OTHER]->(y) RETURN length(p) AS l, [n IN nodes(p) | n.name] AS n, [r IN relationships(p) | type(r)] AS t") == [(2, ["A", "X", "Y"], ["OTHER", "OTHER"])]


def test_shortest_paths(diamond):
    assert rows(diamond, "MATCH p = shortestPath((a:N {name: 'A'})-[:LINK*]->(d:N {name: 'D'})) RETURN length(p) AS l, [n IN nodes(p) | n.name] AS n") == [(2, ["A", "B", "D"])]
    assert bag(diamond, "MATCH p = allShortestPaths((a:N {name: 'A'})-[:LINK*]->(d:N {name: 'D'})) RETURN [n IN nodes(p) | n.name] AS n") == [(["A", "B", "D"],), (["A", "C", "D"],)]
    assert rows(diamond, "MATCH p = shortestPath((d:N {name: 'D'})-[:LINK*]->(a:N {name: 'A'})) RETURN p") == []
    assert rows(diamond, "MATCH p = shortestPath((a:N {name: 'A'})-[:LINK*..1]->(d:N {name: 'D'})) RETURN p") == []
    assert rows(diamond, "MATCH (a:N {name: 'A'}) MATCH p = shortestPath((a)-[:LINK*]-(a)) RETURN length(p) AS l") == [(0,)]


def test_unwind_union_subquery(people):
    assert rows(people, "UNWIND [] AS x RETURN x") == [] and rows(people, "UNWIND null AS x RETURN x") == []
    assert bag(people, "UNWIND [1, 2] AS x UNWIND [3, 4] AS y RETURN x * y AS z") == [(3,), (4,), (6,), (8,)]
    assert bag(people, "RETURN 1 AS x UNION RETURN 1 AS x UNION RETURN 2 AS x") == [(1,), (2,)]
    assert bag(people, "RETURN 1 AS x UNION ALL RETURN 1 AS x") == [(1,), (1,)]
    assert rows(people, "CALL { MATCH (p:Person) RETURN max(p.salary) AS top } RETURN top + 1 AS t") == [(121,)]


def test_expressions(people):
    assert rows(people, "RETURN 10 / 3 AS a, 10 / 4.0 AS b, -7 / 2 AS c, -7 % 3 AS d, 2 ^ 3 ^ 2 AS e, 1 / 0 AS z, 0x1F AS h, 0o17 AS o") == [(3, 2.5, -3, -1, 512.0, None, 31, 15)]
    assert rows(people, "RETURN true XOR null AS a, true OR null AS b, false AND null AS c, NOT null AS d") == [(None, True, False, None)]
    assert rows(people, "RETURN split('a.b.', '.') AS a, split('abc', '') AS b, substring('hello', 1, 3) AS c, reverse('abc') AS d, left('ab', 5) AS e, 'abc' =~ 'a.*' AS f, 'abc' =~ 'a' AS g, 'a' STARTS WITH 1 AS h") == [(["a", "b", ""], ["a", "b", "c"], "ell", "cba", "ab", True, False, None)]
    assert rows(people, "RETURN [1, 2, 3][-1] AS a, [1, 2][5] AS b, [1, 2, 3, 4][1..-1] AS c, [1] + 2 AS d, 0 + [1] AS e, tail([1]) AS f, head([]) AS g, range(5, 1, -2) AS h, range(3, 1) AS i") == [(3, None, [2, 3], [1, 2], [0, 1], [], None, [5, 3, 1], [])]
    assert rows(people, "RETURN reduce(s = '', x IN ['a', 'b'] | s + x) AS a, [x IN [1, 2, 3] WHERE x > 1 | x * 2.0] AS b, single(x IN [1, 2] WHERE x = 1) AS c, none(x IN [] WHERE x = 1) AS d") == [("ab", [4.0, 6.0], True, True)]
    assert rows(people, "RETURN toInteger('3.9') AS a, toInteger('x') AS b, toFloat('1') AS c, toBoolean('TRUE') AS d, toString(1.0) AS e, toString(true) AS f, ceil(3.2) AS g, floor(3.8) AS h, round(3.5) AS i, sign(-2.5) AS j, valueType(1) AS k") == [(3, None, 1.0, True, "1.0", "true", 4, 3, 4, -1, "INTEGER")]
    assert rows(people, "RETURN {a: 1, b: {c: [1, 2]}}.b.c[1] AS a, keys({z: 1, a: 2}) AS b, {a: 1}.nope AS c, coalesce(null, 2) AS d, toUpper(null) AS e") == [(2, ["a", "z"], None, 2, None)]
    assert rows(people, "RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS a, CASE WHEN null THEN 1 ELSE 2 END AS b, 1 < 2 < 3 AS c, 3 > 2 > 2 AS d") == [("b", 2, True, False)]


def test_temporal(people):
    assert rows(people, "RETURN toString(duration({months: 2, days: 5, hours: 1})) AS d, duration({minutes: 90}).hours AS h, duration({minutes: 90}).minutesOfHour AS m") == [("P2M5DT3600S", 1, 30)]
    assert rows(people, "WITH datetime('2024-01-31T10:00:00') AS d RETURN d.year AS y, d.hour AS h, (d + duration({months: 1})).day AS nd, (d - datetime('2024-01-30')).days AS days, datetime({epochMillis: 1000}).second AS s") == [(2024, 10, 29, 1, 1)]
    with pytest.raises(CypherError):
        people.read("RETURN datetime({foo: 1})")


def test_entities_in_lists(people):
    assert bag(people, "MATCH (p:Person {city: 'Rome'}) WITH collect(p) AS ps UNWIND ps AS q MATCH (q)-[:KNOWS]->(r) RETURN q.name AS q, r.name AS r") == [("Alice", "Bob"), ("Alice", "Carol"), ("Carol", "Alice"), ("Eve", "Dave")]
    assert rows(people, "MATCH (a:Person {name: 'Alice'})-[r:KNOWS {since: 2000}]->(b) RETURN startNode(r).name AS s, endNode(r).name AS e, type(r) AS t, labels(a) AS l, elementId(a) AS i, keys(r) AS k") == [("Alice", "Bob", "KNOWS", ["Person"], "node:0", ["since"])]


def test_parameters_and_star(people):
    assert bag(people, "MATCH (p:Person) WHERE p.salary > $low AND p.city IN $cities RETURN p.name", low=85, cities=["Rome"]) == [("Alice",), ("Eve",)]
    assert people.read("MATCH (p:Person {name: 'Bob'}) WITH p.name AS a, p.city AS b RETURN *").collect()[0].asDict() == {"a": "Bob", "b": "Oslo"}
    with pytest.raises(CypherError):
        people.read("RETURN $missing")


REFUSED = {
    "RETURN 1 AS a, 2 AS a": "DuplicateColumn", "RETURN 1 AS a UNION RETURN 2 AS b": "UnionColumnMismatch", "RETURN 1 AS a UNION RETURN 2 AS a UNION ALL RETURN 3 AS a": "MixedUnionAndUnionAll",
    "MATCH (a) CREATE (a:X)": "CreateOnBoundVariable", "CREATE (a)-[]->(b)": "CreateRelationshipWithoutType", "CREATE (a)-[:T]-(b)": "CreateUndirectedRelationship", "CREATE (a)-[:T*2]->(b)": "CreateVariableLengthRelationship",
    "MATCH (a)-[r:T]->(b) CREATE (a)-[r:T]->(b)": "CreateOnBoundRelationship", "MERGE (a)-[r]->(b)": "MergeRelationshipWithoutType", "MERGE (a)-[:T*]->(b)": "MergeVariableLengthRelationship",
    "MATCH (a)-[a:T]->(b) RETURN a": "VariableTypeConflict", "MATCH (a) SET a.x = [(a)-->(b) | b.y]": "PatternInSetValue", "MATCH (a) RETURN DISTINCT a.name AS n ORDER BY b.x": "OrderByUndefinedVariable",
    "MATCH (a) RETURN a.x + count(*) AS n, a.y": "AmbiguousAggregationExpression", "MATCH (a) WHERE count(a) > 1 RETURN a": "InvalidAggregation", "RETURN sum(count(*)) AS x": "InvalidAggregation", "MATCH (a) RETURN b": "UndefinedVariable",
    "MATCH (n) RETURN n.a +": "Syntax", "RETURN 9223372036854775808 AS x": "Syntax", "CALL { CREATE (x) } RETURN 1 AS one": "WriteInSubquery", "CALL algo.louvain() YIELD x RETURN x": "UnknownProcedure", "RETURN nope(1) AS x": "UnknownFunction",
}


@pytest.mark.parametrize("text", REFUSED)
def test_refused(people, text):
    with pytest.raises(CypherError) as problem:
        Graph(people.current).cypher(text)
    assert problem.value.kind == REFUSED[text]


def test_reads_refuse_to_write(people):
    with pytest.raises(CypherError):
        people.read("CREATE (x:Y)")


def test_create_merge_set_delete(spark):
    g = Graph(PropertyGraph(spark))
    g.cypher("CREATE (a:P {name: 'a', n: 1})-[:R {w: 2}]->(b:P:Q {name: 'b'}), (c:P {name: 'c'})")
    assert bag(g, "MATCH (x:P) RETURN x.name, x.n, size(labels(x))") == [("a", 1, 1), ("b", None, 2), ("c", None, 1)]
    assert bag(g, "MATCH (x)-[r:R]->(y:Q) RETURN x.name, r.w, y.name") == [("a", 2, "b")]
    g.cypher("MATCH (a:P {name: 'a'}), (c:P {name: 'c'}) MERGE (a)-[r:S]->(c) ON CREATE SET r.k = 1")
    g.cypher("MATCH (a:P {name: 'a'}), (c:P {name: 'c'}) MERGE (a)-[r:S]->(c) ON MATCH SET r.k = r.k + 1")
    assert bag(g, "MATCH (a)-[r:S]->(c) RETURN a.name, r.k, c.name") == [("a", 2, "c")]
    g.cypher("UNWIND ['d', 'd', 'a'] AS n MERGE (x:P {name: n})")
    assert rows(g, "MATCH (x:P) RETURN count(x) AS n") == [(4,)]
    g.cypher("MATCH (x:P) WHERE x.name IN ['a', 'd'] SET x += {n: 7, z: 'q'}, x:Z")
    assert bag(g, "MATCH (x:Z) RETURN x.name, x.n, x.z") == [("a", 7, "q"), ("d", 7, "q")]
    g.cypher("MATCH (x:P {name: 'a'}) SET x = {name: 'a2'} REMOVE x:Z")
    assert bag(g, "MATCH (x {name: 'a2'}) RETURN x.n, x.z, labels(x)") == [(None, None, ["P"])]
    with pytest.raises(CypherError):
        g.cypher("MATCH (x {name: 'a2'}) DELETE x")
    g.cypher("MATCH (x {name: 'a2'}) DETACH DELETE x")
    assert rows(g, "MATCH (x:P) OPTIONAL MATCH (x)-[r]-() RETURN count(DISTINCT x) AS n, count(r) AS m") == [(3, 0)]
    assert rows(g, "CREATE (n:New {v: 5}) RETURN n.v AS v") == [(5,)]


def test_constraints_indexes_and_procedures(spark, people):
    g = Graph(people.current)
    g.cypher("CREATE INDEX ON :Person(name)")
    assert rows(g, "SHOW INDEXES") == [("Person", "name", "BTREE")]
    g.cypher("DROP INDEX ON :Person(name)")
    assert rows(g, "SHOW INDEXES") == []
    g.cypher("CREATE CONSTRAINT FOR (p:Person) REQUIRE p.name IS UNIQUE")
    with pytest.raises(CypherError):
        g.cypher("CREATE (x:Person {name: 'Alice'})")
    with pytest.raises(CypherError):
        g.cypher("CREATE CONSTRAINT ON (p:Person) ASSERT p.city IS UNIQUE")
    assert rows(g, "CALL db.labels() YIELD label RETURN label") == [("Person",)]
    assert rows(g, "CALL db.relationshipTypes()") == [("KNOWS",)]
    assert {r[0] for r in rows(g, "CALL db.propertyKeys()")} == {"name", "dept", "salary", "city", "since"}


def test_explain_profile_and_tenants(spark, people):
    assert any("MATCH" in r[0].upper() for r in rows(people, "EXPLAIN MATCH (p:Person) RETURN p.name"))
    assert ("rows: 6",) in rows(people, "PROFILE MATCH (p:Person) RETURN p.name")
    many = Graphs(spark)
    many.get("a").cypher("CREATE (x:X)")
    assert many.list() == ["a"] and rows(many.get("b"), "MATCH (x) RETURN count(x) AS n") == [(0,)]
    assert many.get("a").status()["nodes"] == 1


def test_vectors(spark):
    g = build(spark, [{"id": k, "labels": ["P"], "name": n, "e": v} for k, (n, v) in enumerate([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])])], [{"src": 0, "dst": 2, "type": "KNOWS"}])
    got = rows(g, "CALL db.index.vector.queryNodes('P', 'e', [1.0, 0.0], 4) YIELD node, score RETURN node.name AS n, score")
    assert [r[0] for r in got] == ["a", "b", "c", "z"] and got[0][1] < 1e-9 and got[1][1] < 0.1 and got[3][1] == 1.0
    assert rows(g, "CALL db.index.vector.queryNodes('P', 'e', [1.0, 0.0], 2) YIELD node, score MATCH (node)-[:KNOWS]->(x) RETURN x.name AS x") == [("c",)]
    g.cypher("CREATE VECTOR INDEX i FOR (p:P) ON (p.e) OPTIONS {dimensions: 3}")
    g.cypher("CREATE VECTOR INDEX j FOR (p:Q) ON (p.e) OPTIONS {dimensions: 2}")
    assert [r["node"] for r in vector.search_all(g.current, [1.0, 0.0, 0.0], 2).collect()] == [] and vector.search_all(g.current, [1.0, 0.0], 2).collect() == []
    assert len(g.rows("MATCH (p:P) RETURN p.name", timeout=60)) == 4
    with pytest.raises(CypherError):
        g.read("CALL db.index.vector.queryNodes('P', 'e', [1.0, 0.0], 2) YIELD node RETURN node")
    with pytest.raises(CypherError):
        g.cypher("CREATE VECTOR INDEX i FOR (p:P) ON (p.e) OPTIONS {dims: 3}")


def test_hierarchies(spark):
    codes = ["root", "a", "b", "a1", "a2", "x"]
    up = [("a", "root"), ("b", "root"), ("a1", "a"), ("a2", "a"), ("x", "a1"), ("x", "b")]
    g = build(spark, [{"id": k, "labels": ["C"], "code": c, "units": 10**k} for k, c in enumerate(codes)], [{"src": codes.index(a), "dst": codes.index(b), "type": "IS_A"} for a, b in up])
    g.cypher("CREATE HIERARCHY INDEX h ON ()-[:IS_A]->() MEASURE C.units AGGREGATE sum, count")
    assert bag(g, "MATCH (c:C) RETURN c.code, hierarchy_rollup(c, 'sum', 'h') AS s") == [("a", 111010 - 0), ("a1", 101000), ("a2", 10000), ("b", 100100), ("root", 111111), ("x", 100000)]
    assert bag(g, "MATCH (c:C), (r:C {code: 'a'}) WHERE subsumes(c, r) RETURN c.code") == [("a",), ("a1",), ("a2",), ("x",)]
    assert bag(g, "MATCH (c:C), (r:C {code: 'a'}) WHERE NOT subsumes(c, r) RETURN c.code") == [("b",), ("root",)]
    assert rows(g, "MATCH (a:C {code: 'a1'}), (b:C {code: 'a2'}) RETURN hierarchy_lca(a, b) AS l") == [([1],)]
    assert rows(g, "MATCH (a:C {code: 'x'}), (b:C {code: 'b'}) RETURN hierarchy_lca(a, b) AS l") == [([2],)]
    with pytest.raises(CypherError):
        g.cypher("CREATE HIERARCHY INDEX h ON ()-[:IS_A]->()")
    with pytest.raises(CypherError):
        g.cypher("CREATE HIERARCHY INDEX k ON ()-[:IS_A]->() AGGREGATE median")
    loop = build(spark, [{"id": 0, "labels": ["C"]}, {"id": 1, "labels": ["C"]}], [{"src": 0, "dst": 1, "type": "T"}, {"src": 1, "dst": 0, "type": "T"}])
    with pytest.raises(CypherError):
        loop.cypher("CREATE HIERARCHY INDEX h ON ()-[:T]->()")
    g.cypher("DROP HIERARCHY INDEX h")
    assert rows(g, "SHOW HIERARCHY INDEXES") == []


def test_hierarchy_over_a_graph_with_two_parents_is_rolled_up_once_each(spark):
    """A diamond: d lies below b and c, both below a."""
    nodes = [{"id": k, "labels": ["C"], "name": n, "m": m} for k, (n, m) in enumerate([("a", 1), ("b", 10), ("c", 100), ("d", 1000), ("e", 10000)])]
    g = build(spark, nodes, [{"id": k, "src": s, "dst": d, "type": "UP"} for k, (s, d) in enumerate([(1, 0), (2, 0), (3, 1), (3, 2), (4, 3)])])
    g.cypher("CREATE HIERARCHY INDEX h ON ()-[:UP]->() MEASURE C.m AGGREGATE sum, count")
    assert bag(g, "MATCH (c:C) RETURN c.name, hierarchy_rollup(c, 'sum', 'h') AS s, hierarchy_rollup(c, 'count', 'h') AS n") == [("a", 11111, 5), ("b", 11010, 3), ("c", 11100, 3), ("d", 11000, 2), ("e", 10000, 1)]
    assert rows(g, "MATCH (x:C {name: 'd'}), (y:C {name: 'e'}) RETURN hierarchy_lca(x, y) AS l") == [([3],)]
    assert rows(g, "MATCH (x:C {name: 'b'}), (y:C {name: 'c'}) RETURN hierarchy_lca(x, y) AS l") == [([0],)]
    with pytest.raises(CypherError):
        rows(g, "MATCH (c:C) RETURN hierarchy_rollup(c, 'max', 'h') AS m")  # the index does not declare it
    g.cypher("MATCH (x:C {name: 'e'})-[r:UP]->() DELETE r")
    assert bag(g, "MATCH (c:C {name: 'a'}) RETURN hierarchy_rollup(c, 'sum', 'h') AS s") == [(1111,)]  # not from a closure of before
    g.cypher("REBUILD HIERARCHY INDEX h")
    assert bag(g, "MATCH (c:C {name: 'd'}) RETURN hierarchy_rollup(c, 'count', 'h') AS n") == [(1,)]


def test_ids_reach_the_scan_as_keys(spark, data):
    from lattica.sources.tables import shop_graph

    g = Graph(shop_graph(spark, data))
    df = g.read("MATCH (c:Customer) WHERE id(c) IN [562949953421317, 562949953421319, 5] RETURN c.c_custkey AS key")
    assert sorted(r["key"] for r in df.collect()) == [5, 7]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(c_custkey, [5,7])" in plan.partition("PushedFilters")[2]


def test_every_shortest_path_and_one_of_them(spark):
    """Two ways of length two, one of them doubled, and a longer one."""
    nodes = [{"id": k, "labels": ["N"], "k": k} for k in range(6)]
    pairs = [(0, 1), (0, 2), (1, 3), (2, 3), (2, 3), (0, 4), (4, 5), (5, 3)]
    g = build(spark, nodes, [{"id": 10 + k, "src": a, "dst": b, "type": "E"} for k, (a, b) in enumerate(pairs)])
    q = "MATCH p = {}((a:N {{k: 0}})-[:E*]->(b:N {{k: 3}})) RETURN [x IN nodes(p) | x.k] AS ns, size(relationships(p)) AS n"
    assert bag(g, q.format("allShortestPaths")) == [([0, 1, 3], 2), ([0, 2, 3], 2), ([0, 2, 3], 2)]
    assert len(rows(g, q.format("shortestPath"))) == 1


def test_a_path_that_meets_itself_starts_where_rows_do_not_multiply(spark, data, monkeypatch):
    from lattica.plans.lower import Lowerer
    from lattica.sources.tables import shop_graph

    seen, plain = [], Lowerer.edge_rows
    monkeypatch.setattr(Lowerer, "edge_rows", lambda self, rel, *rest: seen.extend(rel.types) or plain(self, rel, *rest))
    text = "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s) RETURN count(*) AS n"
    Graph(shop_graph(spark, data)).read(text)
    assert seen == ["SUPPLIED_BY", "PLACED", "LIVES_IN", "BASED_IN"]


def test_circles_with_labels_properties_and_loops(spark):
    pairs = [(0, 1, "A"), (1, 2, "B"), (2, 0, "C"), (1, 3, "B"), (3, 0, "C"), (3, 4, "C"), (2, 2, "B"), (0, 0, "A")]
    g = build(spark, [{"id": k, "labels": ["N", "Even"] if k % 2 == 0 else ["N"], "k": k} for k in range(5)], [{"src": a, "dst": b, "type": t} for a, b, t in pairs])
    assert bag(g, "MATCH (x)-[:A]->(y)-[:B]->(z)-[:C]->(x:Even) RETURN x.k AS x, y.k AS y, z.k AS z") == [(0, 1, 2), (0, 1, 3)]
    assert bag(g, "MATCH (x {k: 0})-[:A]->(y)-[:B]->(z {k: 3})-[:C]->(x) RETURN y.k AS y") == [(1,)]
    assert bag(g, "MATCH p = (x)-[:A]->(y)-[:B]->(z:Even)-[:C]->(x) WHERE id(x) = 0 RETURN [n IN nodes(p) | n.k] AS ns") == [([0, 1, 2, 0],)]
    assert bag(g, "MATCH (x)-[:A|B]->(x) RETURN x.k AS x") == [(0,), (2,)]
    assert bag(g, "MATCH (x)-[e]->(y)-[f]->(x) RETURN x.k AS x, y.k AS y") == []
    assert bag(g, "MATCH (x:Odd)-[:A]->(y)-[:B]->(z)-[:C]->(x) RETURN x.k AS x") == []


def test_many_rows_at_few_nodes_are_joined_in_blocks(spark, data, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from lattica import catalogue
    from lattica.plans import lower

    one = spark.range(300).select((F.col("id") % 2).alias("a"), F.col("id").alias("x"))
    two = spark.range(200).select((F.col("id") % 3).alias("b"), F.col("id").alias("y"))
    got = lower.in_blocks(one, "a", ["x"], two, "b", ["y"], 16)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, one.join(two, F.col("a") == F.col("b")).collect()))
    share = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(share) < sum(share) / 4
    run = lambda: sorted(map(tuple, catalogue.QUERIES["multi_match"](spark, data).collect()))
    plain = run()
    monkeypatch.setattr(lower.Lowerer, "blocks", lambda *_: 7)
    assert run() == plain and plain


def test_frontiers_of_levels_are_counted_and_meet_the_relationships(spark, monkeypatch):
    from lattica import model
    from lattica.operators import traversal

    nodes = [{"id": k, "labels": ["N"], "k": k} for k in range(8)]
    g = build(spark, nodes, [{"id": 20 + k, "src": a, "dst": b, "type": "E"} for k, (a, b) in enumerate([(0, 1), (0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 1), (6, 7)])])
    seen, plain = [], traversal.meeting
    monkeypatch.setattr(traversal, "meeting", lambda few, n, many, a, rows: seen.append((few.count(), rows)) or plain(few, n, many, a, rows))
    q = "MATCH (a:N {k: 0})-[:E*]->(b:N) RETURN b.k AS k"
    got = bag(g, q)
    assert got == [(1,), (2,), (3,), (4,), (5,)]
    assert seen == [(1, 1), (2, 2), (1, 1), (1, 1), (1, 1)]
    monkeypatch.setattr(model, "LIGHT", 0)
    assert bag(g, q) == got


def test_shortest_paths_meet_relationships_by_small_or_large_frontiers(spark, monkeypatch):
    from lattica import model
    from lattica.operators import traversal

    nodes = [{"id": k, "labels": ["N"], "k": k} for k in range(6)]
    g = build(spark, nodes, [{"id": 10 + k, "src": a, "dst": b, "type": "E"} for k, (a, b) in enumerate([(0, 1), (0, 2), (1, 3), (2, 3), (2, 3), (4, 3), (5, 4), (1, 1)])])
    seen, plain = [], traversal.meeting
    monkeypatch.setattr(traversal, "meeting", lambda few, n, many, a, rows: seen.append((few.count(), rows)) or plain(few, n, many, a, rows))
    q = "MATCH p = allShortestPaths((a:N {k: 0})-[:E*]-(b:N {k: 4})) RETURN [x IN nodes(p) | x.k] AS ns, size(relationships(p)) AS n"
    got = bag(g, q)
    assert got == [([0, 1, 3, 4], 3), ([0, 2, 3, 4], 3), ([0, 2, 3, 4], 3)]
    assert seen == [(1, 1), (2, 2), (1, 1)]
    monkeypatch.setattr(model, "LIGHT", 0)
    assert bag(g, q) == got
