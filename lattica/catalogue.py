"""Registered queries: one per operator of the engine, each with its counterpart in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.model import ID, EdgeTable, NodeTable, PropertyGraph
from lattica.operators import algorithms
from lattica.sources import files, rdf, tables

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(tables.shop_graph(spark, folder))


def cypher(name: str, text: str, sql: str | None = None, **params) -> None:
    """Register a read query over the shop graph."""
    QUERIES[name] = lambda spark, folder: graph(spark, folder).read(text, params)
    if sql:
        SQL[name] = sql


def coded(name: str, sql: str | None = None):
    def put(f: Run) -> Run:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- scans and filters ---

cypher("scan_label", "MATCH (n:Nation) RETURN n.n_nationkey AS key, n.n_name AS name", "SELECT n_nationkey AS key, n_name AS name FROM nation")
cypher("index_scan", "MATCH (c:Customer) WHERE c.c_acctbal >= 5000 AND c.c_acctbal < 5500 RETURN c.c_custkey AS key, c.c_acctbal AS bal", "SELECT c_custkey AS key, c_acctbal AS bal FROM customer WHERE c_acctbal >= 5000 AND c_acctbal < 5500")
cypher("id_anchor", "MATCH (c:Customer) WHERE id(c) IN [562949953421317, 562949953421319] RETURN c.c_custkey AS key", "SELECT c_custkey AS key FROM customer WHERE c_custkey IN (5, 7)")
cypher("filter_3vl", "MATCH (c:Customer) WHERE NOT (c.c_acctbal < 0 OR c.missing = 1) OR c.c_custkey < 3 RETURN c.c_custkey AS key", "SELECT c_custkey AS key FROM customer WHERE c_custkey < 3")
cypher("inline_props", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
cypher("param_filter", "MATCH (p:Part) WHERE p.p_size > $size AND p.p_type IN $types RETURN p.p_partkey AS key", "SELECT p_partkey AS key FROM part WHERE p_size > 40 AND p_type IN ('STANDARD', 'PROMO')", size=40, types=["STANDARD", "PROMO"])
cypher("label_count", "MATCH (o:Order) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders")
cypher("edge_count", "MATCH ()-[r:PLACED]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM orders")
cypher("edge_type_count", "MATCH (s:Supplier)-[r]->(x) RETURN type(r) AS t, count(r) AS n", "SELECT 'BASED_IN' AS t, count(*) AS n FROM supplier UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
cypher("single_row", "RETURN 1 AS one, 'a' AS a", "SELECT 1::BIGINT AS one, 'a' AS a")
cypher("label_scan_all", "MATCH (n) WHERE n:Region OR n:Nation RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region")

# --- patterns ---

cypher("agg_segment_orders", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 RETURN c.c_mktsegment AS segment, count(o) AS orders ORDER BY orders DESC, segment",
       "SELECT c_mktsegment AS segment, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
cypher("one_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'")
cypher("one_hop_in", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:LIVES_IN]->(n:Nation {n_nationkey: 3}) RETURN o.o_orderkey AS o", "SELECT o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
cypher("two_hop", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(*) AS n, round(sum(c.c_acctbal), 2) AS bal",
       "SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
cypher("three_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(o) AS n",
       "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cypher("undirected_hop", "MATCH (n:Nation)-[r]-(x) RETURN n.n_name AS name, count(r) AS n",
       "SELECT n_name AS name, (1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::BIGINT AS n FROM nation")
cypher("multi_type", "MATCH (x)-[:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS name, count(x) AS n", "SELECT n_name AS name, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1")
cypher("expand_into", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s) RETURN n.n_name AS name, count(*) AS n",
       "SELECT n_name AS name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey GROUP BY 1")
cypher("edge_isomorphism", "MATCH (o1:Order)-[e1:CONTAINS]->(p:Part)<-[e2:CONTAINS]-(o2:Order) RETURN p.p_partkey AS p, count(*) AS n",
       "WITH l AS (SELECT *, row_number() OVER () AS rid FROM lineitem) SELECT a.l_partkey AS p, count(*) AS n FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.rid <> b.rid GROUP BY 1")
cypher("edge_props", "MATCH (o:Order)-[e:CONTAINS]->(p:Part) WHERE e.l_quantity > 45 AND p.p_size < 5 RETURN o.o_orderkey AS o, e.l_linenumber AS line, e.l_quantity AS q",
       "SELECT l_orderkey AS o, l_linenumber AS line, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 AND p_size < 5")
cypher("multi_match", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) MATCH (c:Customer)-[:LIVES_IN]->(n) WHERE c.c_acctbal > 9000 RETURN s.s_suppkey AS s, c.c_custkey AS c",
       "SELECT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal > 9000")
cypher("multi_path", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation), (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(s) AS n",
       "SELECT r_name AS region, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
cypher("cartesian_theta", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN a.n_name AS a, b.n_name AS b",
       "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
cypher("named_path", "MATCH p = (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS c, length(p) AS len, size(nodes(p)) AS nodes, [x IN nodes(p) | x.r_name][2] AS region",
       "SELECT c_custkey AS c, 2::BIGINT AS len, 3::BIGINT AS nodes, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")

# --- optional, exists, comprehension ---

cypher("optional_match_count", "MATCH (o:Order) OPTIONAL MATCH (o)-[e:CONTAINS]->(p:Part) RETURN o.o_orderkey AS o, count(p) AS n", "SELECT o_orderkey AS o, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
cypher("optional_where", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:LIVES_IN]-(c:Customer) WHERE c.c_acctbal > 9900 RETURN n.n_name AS name, c.c_custkey AS c",
       "SELECT n_name AS name, c_custkey AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900")
cypher("optional_unshared", "MATCH (r:Region) OPTIONAL MATCH (c:Customer) WHERE c.c_acctbal > 1000000 RETURN r.r_name AS name, c.c_custkey AS c", "SELECT r_name AS name, NULL::BIGINT AS c FROM region")
cypher("exists_semi", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
cypher("not_exists_anti", "MATCH (o:Order) WHERE NOT (o)-[:CONTAINS]->(:Part) RETURN o.o_orderkey AS o", "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
cypher("exists_in_return", "MATCH (s:Supplier) RETURN s.s_suppkey AS s, EXISTS { MATCH (s)-[e:SUPPLIES]->(p:Part) WHERE p.p_size = 50 AND e.n_lines > 1 } AS has, s.s_acctbal > 0 OR exists((s)-[:BASED_IN]->(:Nation {n_nationkey: 1})) AS either",
       "SELECT s_suppkey AS s, EXISTS (SELECT 1 FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) JOIN part ON p_partkey = l_partkey WHERE p_size = 50 AND l_suppkey = s_suppkey) AS has, (s_acctbal > 0 OR s_nationkey = 1) AS either FROM supplier")
cypher("pattern_comprehension", "MATCH (r:Region) RETURN r.r_name AS r, [(r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey > 5 | n.n_nationkey] AS keys",
       "SELECT r_name AS r, coalesce((SELECT list(n_nationkey ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 5), []::INTEGER[]) AS keys FROM region")

# --- aggregation, WITH, ordering ---

cypher("agg_all", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, count(DISTINCT c.c_nationkey) AS nations, round(sum(c.c_acctbal), 2) AS s, round(avg(c.c_acctbal), 6) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi",
       "SELECT c_mktsegment AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
cypher("agg_percentiles", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, round(percentileCont(c.c_acctbal, 0.5), 4) AS median, percentileDisc(c.c_acctbal, 0.9) AS p90, round(stDev(c.c_acctbal), 4) AS sd, round(stDevP(c.c_acctbal), 4) AS sdp",
       "SELECT c_mktsegment AS seg, round(quantile_cont(c_acctbal, 0.5), 4) AS median, quantile_disc(c_acctbal, 0.9) AS p90, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp FROM customer GROUP BY 1")
cypher("agg_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.n_nationkey RETURN r.r_name AS r, collect(DISTINCT n.n_nationkey) AS keys", "SELECT r_name AS r, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
cypher("agg_empty", "MATCH (c:Customer) WHERE c.c_acctbal > 1000000 RETURN count(c) AS n, sum(c.c_acctbal) AS s, collect(c.c_custkey) AS keys", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, []::BIGINT[] AS keys")
cypher("nested_agg", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, round(sum(o.o_totalprice) / count(DISTINCT c), 6) AS per, count(*) + 1 AS n1",
       "SELECT c_mktsegment AS seg, round(sum(o_totalprice) / count(DISTINCT c_custkey), 6) AS per, count(*) + 1 AS n1 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cypher("group_entity", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 20 RETURN c.c_name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 20")
cypher("with_topk_expand", "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, count(o) AS n",
       "SELECT c_custkey AS c, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cypher("degree_agg", "MATCH (p:Part)<-[e:CONTAINS]-(o:Order) RETURN p.p_partkey AS p, count(o) AS n ORDER BY n DESC, p LIMIT 25", "SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, p LIMIT 25")
cypher("semi_join_agg", "MATCH (c:Customer)-[:PLACED]->(o:Order) MATCH (o)-[e:CONTAINS]->(p:Part) WHERE p.p_size = 1 RETURN c.c_mktsegment AS seg, count(DISTINCT o) AS n",
       "SELECT c_mktsegment AS seg, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 1 GROUP BY 1")
cypher("distinct_limit", "MATCH (p:Part) RETURN DISTINCT p.p_size AS size ORDER BY size SKIP 5 LIMIT 10", "SELECT DISTINCT p_size AS size FROM part ORDER BY size LIMIT 10 OFFSET 5")
cypher("order_nulls", "MATCH (o:Order) OPTIONAL MATCH (o)-[e:CONTAINS]->(:Part) WHERE e.l_quantity > 49 WITH o, max(e.l_quantity) AS q RETURN o.o_orderkey AS o, q ORDER BY q DESC, o LIMIT 20",
       "SELECT o_orderkey AS o, max(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 GROUP BY 1 ORDER BY q DESC NULLS FIRST, o LIMIT 20")
cypher("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_acctbal, k SKIP 10 LIMIT 5", "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5 OFFSET 10")
cypher("tpch_q1", "MATCH (:Order)-[l:CONTAINS]->(:Part) WHERE l.l_shipdate <= datetime('1998-09-02') RETURN l.l_returnflag AS rf, l.l_linestatus AS ls, sum(l.l_quantity) AS qty, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS rev, count(*) AS n",
       "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
cypher("revenue_by_region", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) RETURN r.r_name AS region, round(sum(l.l_extendedprice * (1 - l.l_discount)), 1) AS rev",
       "SELECT r_name AS region, round(sum(l_extendedprice * (1 - l_discount)), 1) AS rev FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

# --- rows, sets, subqueries ---

cypher("unwind_range", "UNWIND range(1, 5) AS x UNWIND [10, 20] AS y RETURN x, y, x * y AS z", "SELECT x, y, x * y AS z FROM (SELECT unnest(range(1, 6)) AS x), (SELECT unnest([10, 20]::BIGINT[]) AS y)")
cypher("unwind_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS ns UNWIND ns AS n MATCH (n)<-[:BASED_IN]-(s:Supplier) RETURN r.r_name AS r, count(s) AS n",
       "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
cypher("union_all", "MATCH (c:Customer) WHERE c.c_acctbal < -900 RETURN c.c_name AS name UNION ALL MATCH (s:Supplier) WHERE s.s_acctbal < 0 RETURN s.s_name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal < -900 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 0")
cypher("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
cypher("call_subquery", "CALL { MATCH (n:Nation) RETURN n.n_regionkey AS r, count(*) AS n } RETURN r, n * 2 AS n2", "SELECT n_regionkey AS r, count(*) * 2 AS n2 FROM nation GROUP BY 1")
cypher("case_forms", "MATCH (p:Part) RETURN p.p_partkey AS p, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'mid' ELSE 'big' END AS kind, CASE p.p_size WHEN 1 THEN 'one' END AS one",
       "SELECT p_partkey AS p, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS kind, CASE p_size WHEN 1 THEN 'one' END AS one FROM part")
cypher("strings", "MATCH (n:Nation) RETURN toUpper(n.n_name) AS u, toLower(n.n_name) AS l, substring(n.n_name, 1, 3) AS sub, left(n.n_name, 2) AS le, right(n.n_name, 2) AS ri, reverse(n.n_name) AS rev, size(n.n_name) AS sz, replace(n.n_name, 'A', '_') AS rep, split(n.n_name, '_') AS sp, n.n_name STARTS WITH 'N' AS sw, n.n_name CONTAINS '1' AS co, n.n_name =~ '.*1' AS re, 'x' + n.n_name + toString(n.n_nationkey) AS cat, trim('  a ') AS tr",
       "SELECT upper(n_name) AS u, lower(n_name) AS l, substr(n_name, 2, 3) AS sub, left(n_name, 2) AS le, right(n_name, 2) AS ri, reverse(n_name) AS rev, length(n_name) AS sz, replace(n_name, 'A', '_') AS rep, string_split(n_name, '_') AS sp, starts_with(n_name, 'N') AS sw, contains(n_name, '1') AS co, regexp_full_match(n_name, '.*1') AS re, 'x' || n_name || n_nationkey AS cat, 'a' AS tr FROM nation")
cypher("maths", "MATCH (p:Part) WITH p.p_size AS s, p.p_retailprice AS r, p.p_partkey AS k RETURN k, abs(-s) AS a, ceil(r) AS c, floor(r) AS f, round(r) AS ro, sign(s - 25) AS sg, s / 7 AS d, s % 7 AS m, s ^ 2 AS pw, round(sqrt(s), 6) AS sq, round(log(r), 6) AS lg, round(sin(s) + cos(s) + haversin(s), 6) AS tri, round(degrees(pi()), 3) AS deg, -s / 7 AS nd",
       "SELECT p_partkey AS k, abs(-p_size) AS a, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, round(p_retailprice)::BIGINT AS ro, sign(p_size - 25)::BIGINT AS sg, (p_size // 7)::BIGINT AS d, (p_size % 7)::BIGINT AS m, p_size::DOUBLE ** 2 AS pw, round(sqrt(p_size), 6) AS sq, round(ln(p_retailprice), 6) AS lg, round(sin(p_size) + cos(p_size) + (1 - cos(p_size)) / 2, 6) AS tri, 180.0::DOUBLE AS deg, trunc(-p_size / 7)::BIGINT AS nd FROM part")
cypher("lists", "UNWIND range(1, 6) AS n WITH n, range(1, n) AS xs RETURN n, size(xs) AS sz, head(xs) AS h, last(xs) AS la, tail(xs) AS t, xs[0] AS f, xs[-1] AS l1, xs[1..3] AS sl, [x IN xs WHERE x % 2 = 0 | x * 10] AS ev, all(x IN xs WHERE x < 5) AS al, any(x IN xs WHERE x = 5) AS an, none(x IN xs WHERE x > 3) AS no, single(x IN xs WHERE x = 2) AS si, reduce(a = 0, x IN xs | a + x) AS re, xs + [99] AS app, 3 IN xs AS has, reverse(xs) AS rv",
       "SELECT n, len(xs) AS sz, xs[1] AS h, xs[-1] AS la, xs[2:] AS t, xs[1] AS f, xs[-1] AS l1, xs[2:3] AS sl, list_transform(list_filter(xs, lambda x: x % 2 = 0), lambda x: x * 10) AS ev, n < 5 AS al, n >= 5 AS an, n <= 3 AS no, n >= 2 AS si, list_sum(xs)::BIGINT AS re, list_append(xs, 99) AS app, n >= 3 AS has, list_reverse(xs) AS rv FROM (SELECT n, range(1, n + 1) AS xs FROM (SELECT unnest(range(1, 7)) AS n))")
cypher("maps", "UNWIND [1, 2, 3] AS i WITH {a: i, b: {c: i * 2}} AS m RETURN m.a AS a, m.b.c AS c, m['a'] AS a2, m.zzz AS z, keys(m) AS ks", "SELECT i AS a, i * 2 AS c, i AS a2, NULL::VARCHAR AS z, ['a', 'b'] AS ks FROM (SELECT unnest([1, 2, 3]::BIGINT[]) AS i)")
cypher("conversions", "UNWIND ['12', '3.9', 'x', 'true'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(toInteger(s)) AS st, coalesce(toInteger(s), -1) AS co",
       "SELECT * FROM (VALUES ('12', 12::BIGINT, 12.0::DOUBLE, NULL::BOOLEAN, '12', 12::BIGINT), ('3.9', 3, 3.9, NULL, '3', 3), ('x', NULL, NULL, NULL, NULL, -1), ('true', NULL, NULL, true, NULL, -1)) t(s, i, f, b, st, co)")
cypher("temporal", "MATCH (o:Order) RETURN o.o_orderkey AS o, o.o_orderdate.year AS y, o.o_orderdate.month AS m, o.o_orderdate.day AS d, (o.o_orderdate + duration({days: 10, months: 1})).month AS m2, (o.o_orderdate - datetime('1995-01-01')).days AS days",
       "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, month(o_orderdate + INTERVAL 1 MONTH + INTERVAL 10 DAY) AS m2, date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) // 86400 AS days FROM orders")
cypher("entity_functions", "MATCH (s:Supplier)-[r:BASED_IN]->(n:Nation) RETURN id(s) % 1000 AS sid, type(r) AS t, labels(n) AS ls, startNode(r).s_name AS sn, endNode(r).n_name AS en, keys(n) AS ks, properties(n).n_name AS pn",
       "SELECT (s_suppkey + 3 * 281474976710656) % 1000 AS sid, 'BASED_IN' AS t, ['Nation'] AS ls, s_name AS sn, n_name AS en, ['n_name', 'n_nationkey', 'n_regionkey'] AS ks, n_name AS pn FROM supplier JOIN nation ON n_nationkey = s_nationkey")
cypher("chained_comparison", "MATCH (p:Part) WHERE 10 < p.p_size <= 12 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size > 10 AND p_size <= 12")
cypher("star_projection", "MATCH (r:Region) WITH r.r_regionkey AS k, r.r_name AS name RETURN *", "SELECT r_regionkey AS k, r_name AS name FROM region")

# --- variable length and shortest paths ---

EVENTS = "WITH nx AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
cypher("varlen_1_3", "MATCH (a:Event)-[:NEXT*1..3]->(b:Event) RETURN a.event_id AS a, b.event_id AS b",
       "WITH RECURSIVE nx AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), r AS (SELECT a, b, 1 AS d FROM nx WHERE b IS NOT NULL UNION ALL SELECT r.a, nx.b, d + 1 FROM r JOIN nx ON nx.a = r.b WHERE d < 3 AND nx.b IS NOT NULL) SELECT DISTINCT a, b FROM r")
cypher("varlen_0", "MATCH (s:Supplier)-[:BASED_IN|IN_REGION*0..2]->(x) RETURN s.s_suppkey AS s, labels(x)[0] AS label, count(*) AS n",
       "SELECT s_suppkey AS s, unnest(['Supplier', 'Nation', 'Region']) AS label, 1::BIGINT AS n FROM supplier")
cypher("varlen_reach", "MATCH (u:User {user_id: 7})-[:DID]->(a:Event {event_type: 'signup'})-[:NEXT*]->(b:Event) RETURN count(DISTINCT b) AS n",
       EVENTS.replace("WITH", "WITH RECURSIVE", 1) + ", r AS (SELECT event_id AS x FROM events WHERE user_id = 7 AND event_type = 'signup' UNION SELECT nx.b FROM r JOIN nx ON nx.a = r.x WHERE nx.b IS NOT NULL) SELECT count(*) - (SELECT count(*) FROM (SELECT min(ts) FROM events WHERE user_id = 7 AND event_type = 'signup') t(m) WHERE m IS NOT NULL) AS n FROM r")
cypher("varlen_path", "MATCH p = (a:Event)-[:NEXT*2..2]->(b:Event) RETURN a.event_id AS a, length(p) AS len, [x IN nodes(p) | x.event_id] AS ids",
       EVENTS + " SELECT x.a AS a, 2::BIGINT AS len, [x.a, x.b, y.b] AS ids FROM nx x JOIN nx y ON y.a = x.b WHERE y.b IS NOT NULL")


def _copurchase_graph(spark: SparkSession, folder: str, least: int = 1) -> Graph:
    pairs = tables.co_purchase(spark, folder, least)
    parts = spark.read.parquet(f"{folder}/part.parquet")
    nodes = NodeTable(frozenset(["Part"]), parts.select(F.col("p_partkey").alias(ID), "p_partkey", "p_size"))
    edges = pairs.select(F.xxhash64("src", "dst").alias(ID), F.col("src").alias("__src"), F.col("dst").alias("__dst"), "weight")
    return Graph(PropertyGraph(spark, (nodes,), (EdgeTable("WITH_PART", edges, "Part", "Part"),)))


PAIRS = "l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), pairs AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS w FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"


@coded("shortest_path", f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE w >= 2 UNION ALL SELECT b, a FROM pairs WHERE w >= 2), r AS (SELECT 0::BIGINT AS x, 0 AS d UNION SELECT e.b, d + 1 FROM r JOIN e ON e.a = r.x WHERE d < 6) SELECT x AS b, min(d)::BIGINT AS len FROM r WHERE x <> 0 GROUP BY 1")
def _shortest(spark: SparkSession, folder: str) -> DataFrame:
    return _copurchase_graph(spark, folder, 2).read("MATCH p = shortestPath((a:Part {p_partkey: 0})-[:WITH_PART*..6]-(b:Part)) WHERE b.p_partkey <> 0 RETURN b.p_partkey AS b, length(p) AS len")


#: Numbers of shortest paths from part 0, level by level.
_LEVELS = "v0 AS (SELECT 0::BIGINT AS x, 1::BIGINT AS n)" + "".join(
    f", v{k} AS (SELECT e.b AS x, sum(n)::BIGINT AS n FROM v{k - 1} JOIN e ON e.a = v{k - 1}.x WHERE " + " AND ".join(f"e.b NOT IN (SELECT x FROM v{j})" for j in range(k)) + " GROUP BY 1)" for k in range(1, 5)
)


@coded("all_shortest", f"WITH {PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), {_LEVELS} " + " UNION ALL ".join(f"SELECT x AS t, {k}::BIGINT AS len, n FROM v{k}" for k in range(1, 5)))
def _all_shortest(spark: SparkSession, folder: str) -> DataFrame:
    return _copurchase_graph(spark, folder).read("MATCH p = allShortestPaths((a:Part {p_partkey: 0})-[:WITH_PART*..4]-(b:Part)) WHERE b.p_partkey <> 0 RETURN b.p_partkey AS t, length(p) AS len, count(*) AS n")


# --- algorithms ---


def _call(name: str, text: str, sql: str | None = None, least: int = 2) -> None:
    QUERIES[name] = lambda spark, folder: _copurchase_graph(spark, folder, least).read(text)
    if sql:
        SQL[name] = sql


UND = "e AS (SELECT a, b FROM pairs WHERE w >= 2 UNION ALL SELECT b, a FROM pairs WHERE w >= 2)"
_call("algo_wcc", "CALL algo.wcc('Part', 'WITH_PART') YIELD node, componentId RETURN node.p_partkey AS p, componentId AS c",
      f"WITH RECURSIVE {PAIRS}, {UND}, r AS (SELECT p_partkey AS x, p_partkey AS c FROM part UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.x WHERE r.c < e.b) SELECT x AS p, min(c) AS c FROM r GROUP BY 1")
_call("algo_triangles", "CALL algo.triangleCount() YIELD triangles RETURN triangles", f"WITH {PAIRS}, t AS (SELECT a, b FROM pairs WHERE w >= 2) SELECT count(*) AS triangles FROM t x JOIN t y ON x.b = y.a JOIN t z ON z.a = x.a AND z.b = y.b")
_call("algo_lcc", "CALL algo.lcc() YIELD node, coefficient RETURN node.p_partkey AS p, round(coefficient, 6) AS c",
      f"WITH {PAIRS}, {UND}, d AS (SELECT a, count(*) AS d FROM e GROUP BY 1), t AS (SELECT x.a, count(*) AS n FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT p_partkey AS p, round(CASE WHEN d > 1 THEN 2 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END, 6)::DOUBLE AS c FROM part LEFT JOIN d ON d.a = p_partkey LEFT JOIN t ON t.a = p_partkey")
_call("algo_pagerank", "CALL algo.pageRank('Part', 'WITH_PART', {iterations: 3, damping: 0.85}) YIELD node, score RETURN node.p_partkey AS p, round(score, 9) AS s",
      f"WITH {PAIRS}, e AS (SELECT a, b FROM pairs WHERE w >= 2), o AS (SELECT a, count(*) AS d FROM e GROUP BY 1), v AS (SELECT p_partkey AS x, (SELECT count(*) FROM part)::DOUBLE AS n FROM part), "
      + ", ".join(f"r{k} AS (SELECT v.x, {'1.0 / n' if k == 0 else f'0.15 / n + 0.85 * (coalesce((SELECT sum(r.s / o.d) FROM e JOIN r{k - 1} r ON r.x = e.a JOIN o ON o.a = e.a WHERE e.b = v.x), 0) + (SELECT sum(r.s) FROM r{k - 1} r WHERE r.x NOT IN (SELECT a FROM o)) / n)'} AS s FROM v)" for k in range(4))
      + " SELECT x AS p, round(s, 9) AS s FROM r3")
_call("algo_cdlp", "CALL algo.cdlp('Part', 'WITH_PART', {maxIterations: 2}) YIELD node, communityId RETURN node.p_partkey AS p, communityId AS c",
      f"WITH {PAIRS}, {UND}, l1 AS (SELECT a AS x, min(b) AS c FROM e GROUP BY 1), s1 AS (SELECT p_partkey AS x, coalesce(c, p_partkey) AS c FROM part LEFT JOIN l1 ON x = p_partkey), v2 AS (SELECT e.a AS x, s1.c, count(*) AS n FROM e JOIN s1 ON s1.x = e.b GROUP BY 1, 2), b2 AS (SELECT x, c FROM v2 QUALIFY row_number() OVER (PARTITION BY x ORDER BY n DESC, c) = 1) SELECT s1.x AS p, coalesce(b2.c, s1.c) AS c FROM s1 LEFT JOIN b2 ON b2.x = s1.x")
_call("algo_bfs", "CALL algo.bfs(0, 'WITH_PART') YIELD node, distance RETURN node.p_partkey AS p, distance AS d",
      f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs), r AS (SELECT 0::BIGINT AS x, 0 AS d UNION SELECT e.b, d + 1 FROM r JOIN e ON e.a = r.x WHERE d < 8) SELECT x AS p, min(d)::DOUBLE AS d FROM r GROUP BY 1", 1)
_call("algo_lcc_average", "CALL algo.lcc() YIELD average RETURN DISTINCT round(average, 6) AS a",
      f"WITH {PAIRS}, {UND}, d AS (SELECT a, count(*) AS d FROM e GROUP BY 1), t AS (SELECT x.a, count(*) AS n FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT round(avg(CASE WHEN d > 1 THEN 2 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END), 6)::DOUBLE AS a FROM part LEFT JOIN d ON d.a = p_partkey LEFT JOIN t ON t.a = p_partkey")
_call("algo_mst", "CALL algo.mst('weight') YIELD source, target, weight, total_weight RETURN count(*) AS n, round(sum(weight), 3) AS total", None)
_call("algo_shortest", "CALL algo.shortestPath(0, 150, 'WITH_PART') YIELD path, cost RETURN cost",
      f"WITH RECURSIVE {PAIRS}, r AS (SELECT 0::BIGINT AS x, 0 AS d UNION SELECT p.b, d + 1 FROM r JOIN pairs p ON p.a = r.x WHERE d < 8) SELECT min(d)::DOUBLE AS cost FROM r WHERE x = 150 HAVING count(*) > 0", 1)
_call("algo_weighted", "CALL algo.weightedPath(0, 150, 'weight') YIELD path, cost RETURN cost",
      f"WITH RECURSIVE {PAIRS}, r AS (SELECT 0::BIGINT AS x, 0.0::DOUBLE AS d, 0 AS k UNION ALL SELECT x, min(d), min(k) FROM (SELECT p.b AS x, r.d + p.w AS d, r.k + 1 AS k FROM r JOIN pairs p ON p.a = r.x WHERE r.k < 7) GROUP BY x) SELECT min(d) AS cost FROM r WHERE x = 150 HAVING count(*) > 0", 1)
_call("algo_maxflow", "CALL algo.maxFlow(0, 150, 'weight') YIELD max_flow RETURN max_flow", None)
_call("or_solve", "CALL algo.or.solve({label: 'Part', cost_property: 'p_size', budget: 100.0, max_iterations: 20, algorithm: 'jaya'}) YIELD fitness, algorithm RETURN fitness, algorithm")


def _turned_graph(spark: SparkSession, folder: str) -> Graph:
    """Parts bought together twice, each pair pointing up if its keys sum to an even number and down otherwise: a graph with cycles."""
    pairs = tables.co_purchase(spark, folder, 2)
    up = (F.col("src") + F.col("dst")) % 2 == 0
    edges = pairs.select(F.xxhash64("src", "dst").alias(ID), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("__src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("__dst"))
    nodes = NodeTable(frozenset(["Part"]), spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias(ID), "p_partkey"))
    return Graph(PropertyGraph(spark, (nodes,), (EdgeTable("WITH_PART", edges, "Part", "Part"),)))


TURNED = f"{PAIRS}, e AS (SELECT CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS a, CASE WHEN (a + b) % 2 = 0 THEN b ELSE a END AS b FROM pairs WHERE w >= 2)"


@coded("algo_scc", f"WITH RECURSIVE {TURNED}, r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), same AS (SELECT p.x, min(p.y) AS c FROM r p JOIN r q ON q.x = p.y AND q.y = p.x GROUP BY 1) SELECT p_partkey AS p, least(p_partkey, coalesce(c, p_partkey)) AS c FROM part LEFT JOIN same ON x = p_partkey")
def _scc(spark: SparkSession, folder: str) -> DataFrame:
    return _turned_graph(spark, folder).read("CALL algo.scc('Part', 'WITH_PART') YIELD node, componentId RETURN node.p_partkey AS p, componentId AS c")


@coded("algo_triangle_cycles", f"WITH {TURNED} SELECT count(*) AS triangles FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b")
def _cycles(spark: SparkSession, folder: str) -> DataFrame:
    return _turned_graph(spark, folder).read("CALL algo.triangleCount('Part', 'WITH_PART', {cycles: true}) YIELD triangles RETURN triangles")


@coded("algo_lcc_directed", f"WITH {TURNED}, w AS (SELECT a, b, count(*) AS k FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) GROUP BY 1, 2), d AS (SELECT a, sum(k) AS d, count(*) FILTER (k = 2) AS bi FROM w GROUP BY 1), t AS (SELECT x.a, sum(x.k * y.k * z.k) AS n FROM w x JOIN w y ON y.a = x.a AND x.b < y.b JOIN w z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT p_partkey AS p, round(CASE WHEN d * (d - 1) - 2 * bi > 0 THEN coalesce(n, 0) / (d * (d - 1) - 2 * bi) ELSE 0 END, 6)::DOUBLE AS c FROM part LEFT JOIN d ON d.a = p_partkey LEFT JOIN t ON t.a = p_partkey")
def _lcc_directed(spark: SparkSession, folder: str) -> DataFrame:
    return _turned_graph(spark, folder).read("CALL algo.lcc('Part', 'WITH_PART', {directed: true}) YIELD node, coefficient RETURN node.p_partkey AS p, round(coefficient, 6) AS c")


@coded("sssp_weighted", f"WITH RECURSIVE {PAIRS}, r AS (SELECT 0::BIGINT AS x, 0.0::DOUBLE AS d, 0 AS k UNION ALL SELECT x, min(d), min(k) FROM (SELECT p.b AS x, r.d + p.w AS d, r.k + 1 AS k FROM r JOIN pairs p ON p.a = r.x WHERE r.k < 7) GROUP BY x) SELECT x AS p, min(d) AS d FROM r GROUP BY 1")
def _sssp(spark: SparkSession, folder: str) -> DataFrame:
    pairs = tables.co_purchase(spark, folder)
    vertices = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("id"))
    return algorithms.distances(vertices, pairs, 0, True).select(F.col("id").alias("p"), F.col("distance").alias("d"))


# --- vectors ---


def _near(name: str, similarity: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = graph(spark, folder)
        query = [float(x) for x in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id = 0").first()["embedding"]]
        g.cypher(f"CREATE VECTOR INDEX v FOR (n:Vec) ON (n.embedding) OPTIONS {{dimensions: {len(query)}, similarity: '{similarity}'}}")
        return g.read("CALL db.index.vector.queryNodes('Vec', 'embedding', $q, 10) YIELD node, score RETURN node.vec_id AS v, round(score, 5) AS score", q=query)

    QUERIES[name] = run
    SQL[name] = f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS v, {sql} AS s FROM embeddings, q ORDER BY s, v LIMIT 10) SELECT v, round(s, 5) + 0.0 AS score FROM d"


_near("knn_cosine", "cosine", "greatest(1 - list_cosine_similarity(embedding::DOUBLE[], q), 0)")
_near("knn_l2", "l2", "list_distance(embedding::DOUBLE[], q)")
_near("knn_ip", "inner", "1 - list_inner_product(embedding::DOUBLE[], q)")

# --- hierarchies ---

GEO = "CREATE HIERARCHY INDEX geo ON ()-[:LIVES_IN|IN_REGION]->() MEASURE Customer.c_acctbal AGGREGATE sum, count, min, max"


def _geo(name: str, text: str, sql: str | None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = graph(spark, folder)
        g.cypher(GEO)
        return g.read(text)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_geo("hier_rollup", "MATCH (r:Region) RETURN r.r_name AS r, round(hierarchy_rollup(r, 'sum', 'geo'), 2) AS s, hierarchy_rollup(r, 'count', 'geo') AS n",
     "SELECT r_name AS r, round(sum(c_acctbal), 2) AS s, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_geo("hier_subsumes", "MATCH (c:Customer), (r:Region {r_regionkey: 2}) WHERE subsumes(c, r) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
_geo("hier_not_subsumes", "MATCH (n:Nation), (r:Region {r_regionkey: 2}) WHERE NOT subsumes(n, r) RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey <> 2")
_geo("hier_lca", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey RETURN a.n_nationkey AS a, b.n_nationkey AS b, hierarchy_lca(a, b) AS l",
     "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN [a.n_regionkey::BIGINT] ELSE []::BIGINT[] END AS l FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
_geo("hier_topk", "MATCH (n:Nation) RETURN n.n_name AS n, round(hierarchy_rollup(n, 'sum', 'geo'), 2) AS s ORDER BY s DESC, n LIMIT 5",
     "SELECT n_name AS n, round(sum(c_acctbal), 2) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY s DESC, n LIMIT 5")
cypher("hier_expand", "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*0..]->(r:Region {r_regionkey: 1}) RETURN round(sum(c.c_acctbal), 2) AS s", "SELECT round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")

# --- writes ---


def _write(name: str, steps: list[str], read: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = graph(spark, folder)
        for s in steps:
            g.cypher(s)
        return g.read(read)

    QUERIES[name] = run
    SQL[name] = sql


_write("create_delta", ["CREATE (a:City {name: 'A', size: 3})-[:ROAD {km: 5}]->(b:City {name: 'B'})", "MATCH (a:City {name: 'A'}) CREATE (a)-[:ROAD {km: 7}]->(:City {name: 'C', size: 9})"],
       "MATCH (a:City)-[r:ROAD]->(b:City) RETURN a.name AS a, r.km AS km, b.name AS b, b.size AS size", "SELECT * FROM (VALUES ('A', 5::BIGINT, 'B', NULL::BIGINT), ('A', 7, 'C', 9)) t(a, km, b, size)")
_write("match_create", ["MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_regionkey = 1 CREATE (n)-[:TAGGED]->(:Tag {name: n.n_name})"], "MATCH (n:Nation)-[:TAGGED]->(t:Tag) RETURN n.n_nationkey AS k, t.name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
_write("merge_idempotent", ["UNWIND ['x', 'y', 'x'] AS v MERGE (t:Tag {name: v}) ON CREATE SET t.made = 1 ON MATCH SET t.again = 1", "MERGE (t:Tag {name: 'x'}) ON MATCH SET t.seen = true"],
       "MATCH (t:Tag) RETURN t.name AS name, t.made AS made, t.seen AS seen", "SELECT * FROM (VALUES ('x', 1::BIGINT, true), ('y', 1, NULL)) t(name, made, seen)")
_write("merge_edge", ["MATCH (r:Region), (n:Nation) WHERE r.r_regionkey = 0 AND n.n_nationkey < 3 MERGE (r)-[:HOLDS]->(n)", "MATCH (r:Region {r_regionkey: 0}), (n:Nation {n_nationkey: 1}) MERGE (r)-[:HOLDS]->(n)"], "MATCH (r)-[h:HOLDS]->(n) RETURN n.n_nationkey AS n, count(h) AS c", "SELECT n_nationkey AS n, 1::BIGINT AS c FROM nation WHERE n_nationkey < 3")
_write("set_props", ["MATCH (r:Region) WHERE r.r_regionkey < 2 SET r.flag = r.r_name + '!', r.r_name = null", "MATCH (r:Region {r_regionkey: 3}) SET r += {flag: 'z'}"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name, r.flag AS flag",
       "SELECT r_regionkey AS k, CASE WHEN r_regionkey >= 2 THEN r_name END AS name, CASE WHEN r_regionkey < 2 THEN r_name || '!' WHEN r_regionkey = 3 THEN 'z' END AS flag FROM region")
_write("set_labels", ["MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n:Special", "MATCH (n:Special) WHERE n.n_nationkey > 12 REMOVE n:Special"], "MATCH (n:Special) RETURN n.n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2 AND n_nationkey <= 12")
_write("delete_detach", ["MATCH (n:Nation) WHERE n.n_nationkey < 5 DETACH DELETE n"], "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_nationkey >= 5")
_write("delete_edges", ["MATCH (n:Nation)-[r:IN_REGION]->(x:Region {r_regionkey: 1}) DELETE r"], "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r:Region) RETURN n.n_nationkey AS k, r.r_regionkey AS r", "SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS r FROM nation")
_write("foreach_create", ["FOREACH (x IN [1, 2, 3] | CREATE (:Num {v: x * 2}))"], "MATCH (n:Num) RETURN n.v AS v", "SELECT unnest([2, 4, 6]::BIGINT[]) AS v")
_write("create_index_show", ["CREATE INDEX ON :Customer(c_acctbal)", "CREATE CONSTRAINT ON (c:Customer) ASSERT c.c_custkey IS UNIQUE"], "SHOW INDEXES", "SELECT 'Customer' AS label, 'c_acctbal' AS property, 'BTREE' AS type")
cypher("db_labels", "CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Customer', 'Document', 'Event', 'Item', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'User', 'Vec']) AS label")

# --- sources and sinks ---


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share."""
    import uuid

    from lattica.model import checkpointed

    checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@coded("snapshot_roundtrip", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.shop_graph(spark, folder)
    small = PropertyGraph(spark, tuple(t for t in g.nodes if t.labels & {"Region", "Nation"}), tuple(e for e in g.edges if e.type == "IN_REGION"))
    path = _scratch(spark, "snapshot")
    files.save_snapshot(small, path)
    return Graph(files.load_snapshot(spark, path)).read("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


@coded("jsonl_roundtrip", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
def _jsonl(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.shop_graph(spark, folder)
    small = PropertyGraph(spark, tuple(t for t in g.nodes if t.labels & {"Region", "Nation"}), tuple(e for e in g.edges if e.type == "IN_REGION"))
    path = _scratch(spark, "jsonl")
    files.export_jsonl(small, path)
    return Graph(files.import_jsonl(spark, path)).read("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


@coded("csv_import", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 5000")
def _csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "csv")
    spark.read.parquet(f"{folder}/customer.parquet").write.option("header", True).csv(path)
    return Graph(files.import_csv(PropertyGraph(spark), path, "Cust", "c_custkey")).read("MATCH (c:Cust) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k, c.c_name AS name")


@coded("json_import", "SELECT p_partkey AS k, p_size AS size FROM part WHERE p_size > 45")
def _json(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "json")
    spark.read.parquet(f"{folder}/part.parquet").write.json(path)
    return Graph(files.import_json(PropertyGraph(spark), path, "P", "p_partkey", lines=True)).read("MATCH (c:P) WHERE c.p_size > 45 RETURN c.p_partkey AS k, c.p_size AS size")


@coded("rdf_pattern", "SELECT n_name AS name, count(*) AS n FROM nation GROUP BY 1")
def _rdf(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    subject = t("iri", F.concat(F.lit("http://example.org/nation/"), F.col("n_nationkey").cast("string")))
    triples = nation.select(subject.alias("s"), t("iri", F.lit("http://xmlns.com/foaf/0.1/name")).alias("p"), t("literal", F.col("n_name")).alias("o"), F.lit(None).cast("string").alias("g"))
    path = _scratch(spark, "rdf")
    rdf.write_ntriples(triples, path)
    return rdf.pattern(rdf.read_ntriples(spark, path), p="foaf:name").groupBy(F.col("o")["value"].alias("name")).agg(F.count("*").alias("n"))


@coded("pca", None)
def _pca(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select(*[F.col("embedding")[i].alias(f"x{i}") for i in range(8)])
    return algorithms.principal_components(df, [f"x{i}" for i in range(8)], 3)


@coded("stream_edges", "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1")
def _stream(spark: SparkSession, folder: str) -> DataFrame:
    from lattica.streaming import ingest

    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    path, state = _scratch(spark, "stream"), _scratch(spark, "state")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    ingest.append_edges(stream, path, state, "user_id", "event_id", ("event_type",)).awaitTermination()
    whole = ingest.extended(PropertyGraph(spark), "DID", path)
    return whole.scan_edges(["DID"], []).groupBy(F.col("__src").alias("u")).agg(F.count("*").alias("n"))
