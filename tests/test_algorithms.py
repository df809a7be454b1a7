"""Graph algorithms against brute force on small random graphs."""

import random
from collections import Counter, defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lattica.graph import CypherError, Graph
from lattica.model import PropertyGraph
from lattica.operators import algorithms as al
from lattica.operators import optimize


def random_graph(seed, n=14, m=26):
    rng = random.Random(seed)
    return list(range(n)), [(rng.randrange(n), rng.randrange(n), rng.randint(1, 9)) for _ in range(m)]


def frames(spark, v, e):
    return spark.createDataFrame([(x,) for x in v], "id long"), spark.createDataFrame(e, "src long, dst long, weight double") if e else spark.createDataFrame([], "src long, dst long, weight double")


@pytest.fixture(scope="module", params=[1, 2])
def graph(request, spark):
    v, e = random_graph(request.param)
    e = [(a, b, float(w)) for a, b, w in e]
    return (v, e, *frames(spark, v, e))


def reachable(v, e, a):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for s, d, _ in e:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_components(graph):
    v, e, fv, fe = graph
    both = e + [(b, a, w) for a, b, w in e]
    assert {r["id"]: r["componentId"] for r in al.components(fv, fe).collect()} == {x: min(reachable(v, both, x)) for x in v}
    reach = {x: reachable(v, e, x) for x in v}
    assert {r["id"]: r["componentId"] for r in al.strong_components(fv, fe).collect()} == {x: min(y for y in v if y in reach[x] and x in reach[y]) for x in v}


def test_page_rank(graph):
    v, e, fv, fe = graph
    out, rank, n = defaultdict(list), dict.fromkeys(v, 1 / len(v)), len(v)
    for a, b, _ in e:
        out[a].append(b)
    for _ in range(20):
        lost = sum(rank[x] for x in v if not out[x])
        new = {x: 0.15 / n + 0.85 * (sum(rank[a] * out[a].count(x) / len(out[a]) for a in v if out[a]) + lost / n) for x in v}
        change, rank = sum(abs(new[x] - rank[x]) for x in v), new
        if change < 1e-4:
            break
    got = {r["id"]: r["score"] for r in al.page_rank(fv, fe).collect()}
    assert got == pytest.approx(rank, abs=1e-9) and sum(got.values()) == pytest.approx(1)


def test_label_propagation(graph):
    v, e, fv, fe = graph
    label = {x: x for x in v}
    for _ in range(5):
        votes = {x: Counter() for x in v}
        for a, b, _ in e:
            votes[a][label[b]] += 1
            votes[b][label[a]] += 1
        label = {x: min(votes[x], key=lambda k: (-votes[x][k], k)) if votes[x] else label[x] for x in v}
    assert {r["id"]: r["communityId"] for r in al.label_propagation(fv, fe, 5).collect()} == label


def test_triangles_and_clustering(graph):
    v, e, fv, fe = graph
    near = defaultdict(set)
    for a, b, _ in e:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    tri = [t for t in combinations(v, 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]]
    assert al.triangle_count(fe).first()[0] == len(tri)
    want = {x: (2 * sum(x in t for t in tri) / (len(near[x]) * (len(near[x]) - 1)) if len(near[x]) > 1 else 0.0) for x in v}
    assert {r["id"]: r["coefficient"] for r in al.clustering(fv, fe).collect()} == pytest.approx(want)
    arcs = {(a, b) for a, b, _ in e if a != b}
    side = lambda a, b: ((a, b) in arcs) + ((b, a) in arcs)
    directed = {}
    for x in v:  # after Fagiolo, by its formula
        total, twice = sum(side(x, y) for y in near[x]), sum(side(x, y) == 2 for y in near[x])
        turns = sum(side(x, a) * side(a, b) * side(b, x) for a in near[x] for b in near[x] if a != b)
        possible = total * (total - 1) - 2 * twice
        directed[x] = turns / (2 * possible) if possible > 0 else 0.0
    rows = al.clustering(fv, fe, True).collect()
    assert {r["id"]: r["coefficient"] for r in rows} == pytest.approx(directed)
    assert rows[0]["average"] == pytest.approx(sum(directed.values()) / len(v))
    cycles = sum((a, b) in arcs and (b, c) in arcs and (c, a) in arcs for a in v for b in v for c in v if a < b and a < c)
    assert al.triangle_count(fe, True).first()[0] == cycles


def test_directed_clustering_of_a_known_graph(spark):
    v, e = [0, 1, 2, 3], [(0, 1, 1.0), (1, 0, 1.0), (0, 2, 1.0), (0, 3, 1.0), (1, 2, 1.0)]
    got = {r["id"]: r["coefficient"] for r in al.clustering(*frames(spark, v, e), True).collect()}
    assert got[0] == pytest.approx(0.2) and got[3] == 0.0


def test_paths_over_edges_without_weight(spark):
    """Edges of weight zero must not close the predecessors into a circle."""
    e = [(5, 2, 0.0), (1, 2, 0.0), (2, 1, 0.0), (1, 3, 1.0)]
    row = al.cheapest_path(*frames(spark, [1, 2, 3, 5], e), 5, 3, True).first()
    assert (row["path"], row["cost"]) == ([5, 2, 1, 3], 1.0)
    chain = [(k, k + 1, 0.0) for k in range(20)] + [(k + 1, k, 0.0) for k in range(20)]
    row = al.cheapest_path(*frames(spark, list(range(21)), chain), 0, 20, True).first()
    assert (row["path"], row["cost"]) == (list(range(21)), 0.0)
    row = al.cheapest_path(*frames(spark, [1, 2], [(1, 2, 1.0)]), 1, 1, True).first()
    assert (row["path"], row["cost"]) == ([1], 0.0)


def test_principal_components_against_the_covariance(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * [3, 1, 2, 0.5] + rng.normal(size=(60, 1))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    value, vector = np.linalg.eigh(np.cov(x.T))
    for r in al.principal_components(df, ["a", "b", "c", "d"], 3).collect():
        at = 3 - r["component"]
        want = vector[:, at] * (1 if vector[np.abs(vector[:, at]).argmax(), at] > 0 else -1)
        assert r["explained"] == pytest.approx(value[at] / value.sum()) and r["loadings"] == pytest.approx(want.tolist())


def test_distances_and_paths(graph):
    v, e, fv, fe = graph
    dist = {0: 0.0}
    for _ in v:
        for a, b, w in e:
            if a in dist and dist[a] + w < dist.get(b, 1e9):
                dist[b] = dist[a] + w
    assert {r["id"]: r["distance"] for r in al.distances(fv, fe, 0, True).collect()} == dist
    far = max(dist, key=dist.get)
    row = al.cheapest_path(fv, fe, 0, far, True).first()
    assert row["cost"] == dist[far] and row["path"][0] == 0 and row["path"][-1] == far
    hops, queue = {0: 0}, deque([0])
    while queue:
        x = queue.popleft()
        for a, b, _ in e:
            if a == x and b not in hops:
                hops[b] = hops[x] + 1
                queue.append(b)
    assert {r["id"]: r["distance"] for r in al.distances(fv, fe, 0).collect()} == hops
    lost = [x for x in v if x not in dist]
    if lost:
        assert al.cheapest_path(fv, fe, 0, lost[0], True).collect() == []


def test_spanning_forest(graph):
    v, e, fv, fe = graph
    root = {x: x for x in v}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0
    for a, b, w in sorted(e, key=lambda x: x[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert sum(r["weight"] for r in al.spanning_tree(fv, fe, forest=True).collect()) == total
    tree = al.spanning_tree(fv, fe).collect()
    assert len(tree) == sum(find(x) == find(0) for x in v) - 1


def test_max_flow(spark):
    e = [(0, 1, 16.0), (0, 2, 13.0), (1, 2, 10.0), (2, 1, 4.0), (1, 3, 12.0), (3, 2, 9.0), (2, 4, 14.0), (4, 3, 7.0), (3, 5, 20.0), (4, 5, 4.0)]
    _, fe = frames(spark, range(6), e)
    assert al.max_flow(fe, 0, 5).first()[0] == 23.0
    assert al.max_flow(fe, 5, 0).first()[0] == 0.0
    assert al.max_flow(fe.limit(0), 0, 1).first()[0] == 0.0


def test_empty_graphs(spark):
    fv, fe = frames(spark, [], [])
    for out in (al.page_rank(fv, fe), al.components(fv, fe), al.strong_components(fv, fe), al.label_propagation(fv, fe), al.clustering(fv, fe), al.distances(fv, fe, 0), al.spanning_tree(fv, fe)):
        assert out.collect() == []


def test_every_optimizer_finds_the_bowl():
    import numpy as np

    low, high = np.full(4, -5.0), np.full(4, 5.0)
    seen = {}
    for name in optimize.ALGORITHMS:
        x, best, history = optimize.minimise(optimize.FUNCTIONS["sphere"], low, high, name, 20, 100, seed=3)
        assert best < 0.5 and best == history[-1] == pytest.approx(float((x**2).sum())) and all(p >= q for p, q in zip(history, history[1:], strict=False)), name
        assert tuple(history) not in seen, (name, seen.get(tuple(history)))  # no two names are one method
        seen[tuple(history)] = name
    with pytest.raises(CypherError):
        optimize.minimise(optimize.FUNCTIONS["sphere"], low, high, "nosuch")


def test_fronts_of_several_objectives():
    import numpy as np

    assert optimize.front(np.array([[1, 2], [2, 1], [2, 2]])).tolist() == [0, 1]
    assert optimize.ranked(np.array([[3.0, 3.0], [1.0, 2.0], [2.0, 1.0]])).tolist()[-1] == 0
    known = {"zdt1": lambda f: 1 - np.sqrt(f), "zdt2": lambda f: 1 - f**2}
    for name in optimize.PARETO:
        for bench, of in known.items():
            x, v = optimize.pareto(optimize.MULTI[bench], np.zeros(6), np.ones(6), name, 40, 150, seed=2)
            assert len(optimize.front(v)) == len(v) > 20 and (np.abs(optimize.MULTI[bench](x) - v) < 1e-12).all()
            assert np.abs(v[:, 1] - of(v[:, 0])).mean() < 0.05, (name, bench)


def test_solve_over_nodes_of_equal_costs(spark):
    g = Graph(PropertyGraph.build(spark, [{"id": k, "labels": ["Item"], "cost": float(2 + k % 4), "risk": float(5 - k % 4)} for k in range(60)], []))
    one = g.read("CALL algo.or.solve({label: 'Item', cost_property: 'cost', budget: 10.0, max_iterations: 200, algorithm: 'qojaya'}) YIELD fitness, front_size RETURN fitness, front_size").first()
    assert 20.0 <= one["fitness"] < 21.0 and one["front_size"] == 1  # all of the budget on the cheapest: 10 * 2
    two = g.read("CALL algo.or.solve({label: 'Item', cost_properties: ['cost', 'risk'], budget: 10.0, max_iterations: 60}) YIELD fitness, front_size, algorithm RETURN fitness, front_size, algorithm").first()
    assert 20.0 <= two["fitness"] < 24.0 and two["front_size"] > 5 and two["algorithm"] == "nsga2"


def test_principal_components(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) @ np.diag([3.0, 1.0, 0.1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out = al.principal_components(df, ["a", "b", "c"], 2).collect()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [r["explained"] for r in out] == pytest.approx(list(values[:2] / values.sum()))


def test_co_purchase_deals_more_rows_to_more_partitions(spark, data, monkeypatch):
    from lattica import model
    from lattica.sources import tables

    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    seen = []
    for piece in (rows, 1000):
        monkeypatch.setattr(model, "PIECE", piece)
        pairs = tables.co_purchase(spark, data, 1)
        seen.append((pairs.rdd.getNumPartitions(), sorted(map(tuple, pairs.collect()))))
    assert seen[0][1] == seen[1][1]
    assert seen[1][0] == 2 * -(-rows // 1000) > seen[0][0]


def test_small_frontiers_travel_and_large_ones_meet_as_well(spark, monkeypatch):
    from lattica import model

    v, e = random_graph(7, 30, 70)
    fv, fe = frames(spark, v, [(a, b, float(w)) for a, b, w in e])
    arcs = spark.range(1000).select((F.col("id") % 50).alias("src"), (F.col("id") % 70).alias("dst"))
    few = spark.range(3).withColumnRenamed("id", "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are large
    try:
        plan = model.meeting(few, "n", arcs, "src", 3)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = lambda: (sorted(map(tuple, al.distances(fv, fe, 0, True).collect())), al.cheapest_path(fv, fe, 0, 7, True).collect())
    plain = found()
    monkeypatch.setattr(model, "LIGHT", 0)
    assert found() == plain
