"""Files, RDF and streams."""

import json

import pytest

from lattica.graph import CypherError, Graph
from lattica.model import PropertyGraph
from lattica.sources import files, rdf
from lattica.streaming import ingest


def small(spark):
    return PropertyGraph.build(spark, [{"id": 1, "labels": ["A"], "name": "x, \"y\"", "n": 1}, {"id": 2, "labels": ["A", "B"], "name": " X, \"Y\" ", "n": None}, {"id": 3, "labels": [], "z": 1.5}], [{"id": 9, "src": 1, "dst": 2, "type": "R", "w": 2}, {"id": 10, "src": 3, "dst": 1, "type": "S"}])


def read(g):
    return sorted(map(str, Graph(g).read("MATCH (a)-[r]->(b) RETURN id(a) AS a, type(r) AS t, r.w AS w, id(b) AS b, a.name AS n, labels(b) AS l").collect()))


def test_snapshot_and_jsonl(spark, tmp_path):
    g = small(spark)
    files.save_snapshot(g, str(tmp_path / "s"))
    assert read(files.load_snapshot(spark, str(tmp_path / "s"))) == read(g)
    files.export_jsonl(g, str(tmp_path / "j"))
    assert read(files.import_jsonl(spark, str(tmp_path / "j"))) == read(g)
    with pytest.raises(Exception):
        files.load_snapshot(spark, str(tmp_path / "none"))


def test_import_with_dedup(spark, tmp_path):
    g = PropertyGraph.build(spark, [{"id": 1, "labels": ["A"], "k": "Key"}, {"id": 2, "labels": ["A"], "k": " key "}, {"id": 3, "labels": ["A"], "k": "other"}], [{"id": 5, "src": 3, "dst": 2, "type": "R"}])
    files.export_jsonl(g, str(tmp_path / "j"))
    back = Graph(files.import_jsonl(spark, str(tmp_path / "j"), dedup_key="k"))
    assert back.read("MATCH (n:A) RETURN count(n) AS n").first()[0] == 2
    assert back.read("MATCH (a)-[:R]->(b) RETURN id(b) AS b").first()[0] == 1


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\n1,"a, ""b""",3\n2,c,\n')
    (tmp_path / "a.json").write_text('[{"id": 1, "tags": ["x"]}, {"id": 2, "v": 1.5}]')
    g = files.import_csv(PropertyGraph(spark), str(tmp_path / "a.csv"), "C", "id")
    assert sorted(tuple(r) for r in Graph(g).read("MATCH (c:C) RETURN c.name AS name, c.n + 1 AS n").collect()) == [('a, "b"', 4), ("c", None)]
    g = files.import_json(g, str(tmp_path / "a.json"), "J")
    assert sorted(map(str, Graph(g).read("MATCH (c:J) RETURN c.tags AS t, c.v AS v, id(c) > 2 AS fresh").collect())) == sorted(["Row(t=['x'], v=None, fresh=True)", "Row(t=None, v=1.5, fresh=True)"])


NT = r"""# comment
<http://x/a> <http://x/knows> <http://x/b> .
<http://x/a> <http://xmlns.com/foaf/0.1/name> "A \"q\" \n"@en .
_:n1 <http://x/age> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://x/g> .
<http://x/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/T> .
"""


def test_rdf(spark, tmp_path):
    (tmp_path / "a.nt").write_text(NT)
    t = rdf.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert t.count() == 4
    name = rdf.pattern(t, p="foaf:name").first()["o"]
    assert (name["value"], name["lang"], name["kind"]) == ('A "q" \n', "en", "literal")
    assert rdf.pattern(t, g="http://x/g").first()["o"]["datatype"].endswith("integer")
    rdf.write_ntriples(t, str(tmp_path / "out"))
    assert sorted(map(str, rdf.read_ntriples(spark, str(tmp_path / "out")).collect())) == sorted(map(str, t.collect()))
    g = Graph(rdf.to_graph(t))
    assert [tuple(r) for r in g.read("MATCH (a)-[:knows]->(b) RETURN a.iri AS a, b.iri AS b, a.rdf_type AS t").collect()] == [("http://x/a", "http://x/b", ["http://x/T"])]
    rdf.write_jsonld(t, str(tmp_path / "ld"))
    objects = {o["@id"]: o for o in (json.loads(r[0]) for r in spark.read.text(str(tmp_path / "ld")).collect())}
    assert objects["http://x/a"]["http://x/knows"] == [{"@id": "http://x/b"}] and objects["http://x/a"]["http://xmlns.com/foaf/0.1/name"] == [{"@value": 'A "q" \n', "@language": "en"}]
    rdf.write_turtle(t.where("g is null"), str(tmp_path / "ttl"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "ttl")).collect())
    assert rdf.read_turtle(spark, text).count() == 3
    (tmp_path / "bad.nt").write_text("<a> nonsense\n")
    with pytest.raises(Exception):
        rdf.read_ntriples(spark, str(tmp_path / "bad.nt")).collect()
    turtle = rdf.read_turtle(spark, '@prefix e: <http://e/> .\ne:a a e:T ; e:p "v"@en, 5 .\n<http://e/b> e:q e:a .')
    assert turtle.count() == 4 and rdf.pattern(turtle, s="http://e/a").count() == 3


def test_snapshots_keep_definitions(spark, tmp_path):
    g = Graph(PropertyGraph.build(spark, [{"id": k, "labels": ["P"], "name": f"p{k}", "m": k, "e": [1.0, float(k)]} for k in range(4)], [{"src": k + 1, "dst": 0, "type": "UP"} for k in range(3)]))
    for command in ("CREATE INDEX ON :P(name)", "CREATE CONSTRAINT ON (p:P) ASSERT p.name IS UNIQUE", "CREATE VECTOR INDEX v FOR (p:P) ON (p.e) OPTIONS {dimensions: 2, similarity: 'l2'}", "CREATE HIERARCHY INDEX h ON ()-[:UP]->() MEASURE P.m AGGREGATE sum"):
        g.cypher(command)
    files.save_snapshot(g.current, str(tmp_path / "snap"))
    files.export_jsonl(g.current, str(tmp_path / "lines"))
    assert any('"tgt":' in r[0] for r in spark.read.text(str(tmp_path / "lines")).collect())
    for back in (files.load_snapshot(spark, str(tmp_path / "snap")), files.import_jsonl(spark, str(tmp_path / "lines"))):
        h = Graph(back)
        for show in ("SHOW INDEXES", "SHOW CONSTRAINTS", "SHOW VECTOR INDEXES", "SHOW HIERARCHY INDEXES"):
            assert [tuple(r) for r in h.cypher(show).collect()] == [tuple(r) for r in g.cypher(show).collect()] != []
        assert h.read("MATCH (p:P {name: 'p0'}) RETURN hierarchy_rollup(p, 'sum', 'h') AS s").first()["s"] == 6
        assert h.read("CALL db.index.vector.queryNodes('P', 'e', [1.0, 0.0], 1) YIELD node RETURN node.name AS n").first()["n"] == "p0"
        with pytest.raises(CypherError):
            h.cypher("CREATE (:P {name: 'p1'})")
    whole = [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    spark.createDataFrame([(x,) for x in whole[:-1]], "value string").write.text(str(tmp_path / "cut"))
    with pytest.raises(CypherError):
        files.import_jsonl(spark, str(tmp_path / "cut"))
    spark.createDataFrame([('{"t":"n","id":1,"labels":["A"],"props":{"x":1}}',), ('{"t":"n","id":2,"labels":["A"],"props":{}}',), ('{"t":"e","id":1,"src":1,"dst":2,"type":"R","props":{}}',), ('{"t":"other"}',)], "value string").write.text(str(tmp_path / "old"))
    assert Graph(files.import_jsonl(spark, str(tmp_path / "old"))).read("MATCH (a)-[:R]->(b) RETURN a.x AS x").first()["x"] == 1


def test_turtle(spark):
    text = """@base <http://x.org/> . @prefix ex: <http://ex.org/> .
    PREFIX f: <http://f.org/>
    <a> ex:p "one #two" ; a ex:T , <b> . # a comment "not a literal"
    ex:s f:q [ ex:r 1.5, -2, 3e4 ; ex:t true ] , ( "x"@en '''long "q"''' ) .
    [ ex:z _:b.1 ] .
    ex:e f:w "a\\"b\\u00e9"^^ex:dt ;; f:v 'single' ."""
    rows = {(r["s"]["value"], r["p"]["value"].split("/")[-1], r["o"]["value"], r["o"]["lang"], (r["o"]["datatype"] or "").split("#")[-1]) for r in rdf.read_turtle(spark, text).collect()}
    first = "22-rdf-syntax-ns#first"
    assert {
        ("http://x.org/a", "p", "one #two", None, ""), ("http://x.org/a", "22-rdf-syntax-ns#type", "http://ex.org/T", None, ""), ("http://x.org/a", "22-rdf-syntax-ns#type", "http://x.org/b", None, ""),
        ("genid1", "r", "1.5", None, "decimal"), ("genid1", "r", "-2", None, "integer"), ("genid1", "r", "3e4", None, "double"), ("genid1", "t", "true", None, "boolean"), ("http://ex.org/s", "q", "genid1", None, ""),
        ("genid2", first, "x", "en", ""), ("genid3", first, 'long "q"', None, ""), ("http://ex.org/s", "q", "genid2", None, ""), ("genid4", "z", "b.1", None, ""),
        ("http://ex.org/e", "w", 'a"bé', None, "http://ex.org/dt"), ("http://ex.org/e", "v", "single", None, ""),
    } <= rows and len(rows) == 16
    assert rdf.read_turtle(spark, "# nothing\n").collect() == []
    for bad in ("<a> <b> .", "<a> <b> <c>", "x:y <b> <c> .", '<a> <b> "open .', "<a> <b> [ <c> <d> ."):
        with pytest.raises(CypherError):
            rdf.read_turtle(spark, bad)


def test_graph_of_triples_keeps_literals_and_tells_predicates_apart(spark):
    t = rdf.read_turtle(spark, """@prefix a: <http://a/> . @prefix b: <http://b/> . a:x a:knows a:y ; b:knows a:z ; a:age 5 ; a:iri "odd" .""")
    g = Graph(rdf.to_graph(t))
    assert {tuple(r) for r in g.read("MATCH (x)-[r]->(y) RETURN type(r) AS t, y.iri AS y").collect()} == {("http://a/knows", "http://a/y"), ("http://b/knows", "http://a/z")}
    assert [tuple(r) for r in g.read("MATCH (x {iri: 'http://a/x'}) RETURN x.age AS age").collect()] == [("5",)]


def test_equal_rows_of_a_stream_are_relationships_of_their_own(spark, tmp_path):
    spark.createDataFrame([(1, 2)] * 3, "a long, b long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    ingest.append_edges(stream, str(tmp_path / "out"), str(tmp_path / "state"), "a", "b").awaitTermination()
    g = Graph(ingest.extended(PropertyGraph.build(spark, [{"id": k, "labels": ["N"]} for k in (1, 2)], []), "E", str(tmp_path / "out")))
    assert g.read("MATCH (a)-[e:E]->(b) RETURN count(DISTINCT e) AS n").first()["n"] == 3
    assert g.read("MATCH (a)-[e:E]->(b)<-[f:E]-(c) RETURN count(*) AS n").first()["n"] == 6


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "a long, b long, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long, k string").parquet(str(tmp_path / "in"))
    ingest.append_edges(stream, str(tmp_path / "out"), str(tmp_path / "state"), "a", "b", ("k",)).awaitTermination()
    g = ingest.extended(PropertyGraph.build(spark, [{"id": k, "labels": ["N"]} for k in (1, 2, 3)], []), "E", str(tmp_path / "out"))
    assert sorted(r[0] for r in Graph(g).read("MATCH (a)-[e:E]->(b) RETURN e.k AS k").collect()) == ["x", "y"]


def test_windows_of_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 1 as u union all select timestamp'2024-01-01 11:00:00', 1 union all select timestamp'2024-01-02 01:00:00', 2").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, u int").parquet(str(tmp_path / "in"))
    query = ingest.windowed_degree(stream, "ts", "u").writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["u"], r["n"]) for r in spark.sql("select * from degrees").collect()) == [(1, 2), (2, 1)]
