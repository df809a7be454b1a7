"""Graph algorithms over an edge table, as bounded rounds of joins and aggregations.

Each takes vertices(id) and edges(src, dst[, weight]) and gives a DataFrame. Rounds are cut by checkpoints to the
shared folder; the driver sees a number per round at most.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica import model
from lattica.model import checkpointed, meeting


def both_ways(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours once per direction, without loops and repeats."""
    flat = edges.where("src <> dst").select("src", "dst")
    return flat.unionByName(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def page_rank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-4, redistribute: bool = True) -> DataFrame:
    """(id, score): power iteration from 1/N; what dangling vertices hold is spread evenly unless told otherwise."""
    vertices = checkpointed(vertices.select("id").distinct())
    n = vertices.count()
    if not n:
        return vertices.withColumn("score", F.lit(0.0))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = checkpointed(edges.join(degree, "src").select("src", "dst", "degree"))
    base = vertices.join(degree, vertices["id"] == degree["src"], "left").select("id", F.col("degree").isNull().alias("dangling"))
    ranks = checkpointed(base.withColumn("score", F.lit(1.0 / n)))
    for k in range(iterations):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0] if redistribute else 0.0
        sent = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        score = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        new = ranks.select("id", "dangling", F.col("score").alias("old")).join(sent, F.col("id") == sent["dst"], "left").select("id", "dangling", score.alias("score"), "old")
        new = checkpointed(new)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if change < tolerance:
            break
    return ranks.select("id", "score")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, componentId): weak components, named by their least id; large and small stars alternate until nothing moves."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = around.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    state = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = state.select(mark.alias("m")).first()["m"]
    while before[0]:
        state = checkpointed(star(star(state, True), False))
        after = state.select(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    return vertices.select("id").distinct().join(state, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("componentId"))


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, colour): the least colour that reaches each vertex along the edges."""
    state = checkpointed(colour)
    while True:
        got = state.join(edges, state["id"] == edges["src"]).groupBy("dst").agg(F.min("colour").alias("got"))
        new = checkpointed(state.join(got, state["id"] == got["dst"], "left").select("id", F.least("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") < F.col("colour")).alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, componentId): forward-backward colouring with trimming; components are named by their least id."""
    left = checkpointed(vertices.select("id").distinct())
    edges = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        while True:  # a vertex without an edge in or out is its own component
            inner = left.join(edges.select(F.col("src").alias("id")), "id", "left_semi").join(edges.select(F.col("dst").alias("id")), "id", "left_semi")
            trimmed = checkpointed(left.join(inner, "id", "left_anti"))
            if trimmed.isEmpty():
                break
            done.append(trimmed.select("id", F.col("id").alias("componentId")))
            left = checkpointed(inner)
            edges = checkpointed(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        colour = _spread(left.select("id", F.col("id").alias("colour")), edges)
        coloured = checkpointed(edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("c = c2").select("src", "dst"))
        # backwards within a colour from the vertex that names it: who reaches it is in its component
        back = coloured.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        hit, frontier = colour.where("id = colour").select("id", "colour"), colour.where("id = colour").select("id", "colour")
        while not frontier.isEmpty():
            nexts = frontier.join(back, frontier["id"] == back["src"]).select(F.col("dst").alias("id"), "colour").distinct()
            frontier = checkpointed(nexts.join(hit, "id", "left_anti"))
            hit = checkpointed(hit.unionByName(frontier))
        done.append(hit.select("id", F.col("colour").alias("componentId")))
        left = checkpointed(left.join(hit, "id", "left_anti"))
        edges = checkpointed(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    out = done[0] if done else vertices.select("id", F.col("id").alias("componentId")).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def label_propagation(vertices: DataFrame, edges: DataFrame, iterations: int = 100) -> DataFrame:
    """(id, communityId): synchronous; the most frequent label among neighbours in both directions, counted with repeats, least label on ties."""
    around = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))))
    state = checkpointed(vertices.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(iterations):
        votes = around.join(state, around["b"] == state["id"]).groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("a", (-F.col("m.l")).alias("got"))
        new = checkpointed(state.join(best, state["id"] == best["a"], "left").select("id", F.coalesce("got", "label").alias("label"), (F.coalesce("got", "label") != F.col("label")).alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return state.select("id", F.col("label").alias("communityId"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each triangle once. Edges point from the lesser to the greater degree, which bounds the wedges of a hub."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("v").alias("a"), F.col("d").alias("da")), degree.select(F.col("v").alias("b"), F.col("d").alias("db"))
    sized = pairs.join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    to = checkpointed(sized.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    one, two, three = to.select("u", F.col("v").alias("x")), to.select("u", F.col("v").alias("y")), to.select(F.col("u").alias("x"), F.col("v").alias("y"))
    return one.join(two, "u").where("x <> y").join(three, ["x", "y"]).select(F.col("u").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def closed(edges: DataFrame) -> DataFrame:
    """(a, b, c, ab, ba, bc, cb, ac, ca): each triangle once, a < b < c, with the arcs it has (1 or 0)."""
    arcs = edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), (F.col("src") < F.col("dst")).alias("up"))
    sides = checkpointed(arcs.groupBy("x", "y").agg(F.max(F.col("up").cast("int")).alias("to"), F.max((~F.col("up")).cast("int")).alias("fro")))
    ends = F.array_sort(F.array("a", "b", "c"))
    out = triangles(edges).select(*[ends[k].alias(n) for k, n in enumerate("abc")])
    for x, y in ("ab", "bc", "ac"):
        out = out.join(sides.select(F.col("x").alias(x), F.col("y").alias(y), F.col("to").alias(x + y), F.col("fro").alias(y + x)), [x, y])
    return out


def triangle_count(edges: DataFrame, cycles: bool = False) -> DataFrame:
    """(triangles): of all triangles, or of directed cycles a -> b -> c -> a, each once."""
    if not cycles:
        return triangles(edges).agg(F.count("*").alias("triangles"))
    turns = F.col("ab") * F.col("bc") * F.col("ca") + F.col("ac") * F.col("cb") * F.col("ba")
    return closed(edges).agg(F.coalesce(F.sum(turns), F.lit(0)).cast("long").alias("triangles"))


def clustering(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """(id, coefficient, average): links among neighbours over possible ones, and the mean over all vertices.

    Directed, after Fagiolo: every orientation of a triangle counts, a neighbour in both directions counts twice in the degree,
    and pairs that such a neighbour would close with itself do not count as possible.
    """
    if directed:
        sides = [F.col(f"{x}{y}") + F.col(f"{y}{x}") for x, y in ("ab", "bc", "ac")]
        found = closed(edges).select(F.explode(F.array("a", "b", "c")).alias("v"), (sides[0] * sides[1] * sides[2]).alias("n")).groupBy("v").agg(F.sum("n").alias("n"))
        arcs = edges.where("src <> dst").select("src", "dst").distinct()
        around = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("k"))
        degree = around.groupBy("src").agg(F.sum("k").alias("d"), F.sum((F.col("k") == 2).cast("int")).alias("twice"))
        possible = F.col("d") * (F.col("d") - 1) - 2 * F.col("twice")
        value = F.col("n") / possible
    else:
        degree = both_ways(edges).groupBy("src").agg(F.count("*").alias("d"))
        found = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        possible = F.col("d") * (F.col("d") - 1)
        value = 2 * F.col("n") / possible
    joined = vertices.select("id").distinct().join(degree, F.col("id") == degree["src"], "left").join(found, F.col("id") == found["v"], "left")
    out = checkpointed(joined.select("id", F.when(possible > 0, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0)).alias("coefficient")))
    return out.join(F.broadcast(out.agg(F.avg("coefficient").alias("average"))), F.lit(True))


def weights(edges: DataFrame, weighted: bool = True) -> Column:
    """The weight of an edge; 1 where it is missing or not asked for."""
    return F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if weighted and "weight" in edges.columns else F.lit(1.0)


def relaxed(vertices: DataFrame, edges: DataFrame, source: int, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, distance, hops), (src, dst, w)): least distances from the source with the fewest hops that reach them, and the arcs used."""
    arcs = checkpointed(edges.select("src", "dst", weights(edges, weighted).alias("w")).where("w >= 0").groupBy("src", "dst").agg(F.min("w").alias("w")))
    state = checkpointed(vertices.where(F.col("id") == source).distinct().select("id", F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("hops")).alias("best"), F.lit(True).alias("new")))
    while rows := state.where("new").count():
        sent = meeting(state.where("new"), "id", arcs, "src", rows).select(F.col("dst").alias("id"), F.struct((F.col("best.distance") + F.col("w")).alias("distance"), (F.col("best.hops") + 1).alias("hops")).alias("best"))
        merged = state.select("id", "best", F.lit(1).alias("old")).unionByName(sent.withColumn("old", F.lit(0))).groupBy("id").agg(F.min("best").alias("best"), F.min(F.when(F.col("old") == 1, F.col("best"))).alias("had"))
        state = checkpointed(merged.select("id", "best", (F.col("had").isNull() | (F.col("best") < F.col("had"))).alias("new")))
    return state.select("id", "best.distance", "best.hops"), arcs


def distances(vertices: DataFrame, edges: DataFrame, source: int, weighted: bool = False) -> DataFrame:
    """(id, distance) of the vertices that the source reaches: levels of a search, or relaxation until nothing moves.

    Missing weights count as 1, edges of negative weight are skipped.
    """
    return relaxed(vertices, edges, source, weighted)[0].select("id", "distance")


def cheapest_path(vertices: DataFrame, edges: DataFrame, source: int, target: int, weighted: bool = False) -> DataFrame:
    """(path, cost): one cheapest path with the fewest hops, as ids from source to target; least predecessors among equals. No row if there is none.

    Each vertex points at its predecessor, one hop nearer, so edges without weight close no circle. The path is
    gathered by jumps that double: as many rounds as the logarithm of its length.
    """
    dist, arcs = relaxed(vertices, edges, source, weighted)
    end = dist.where(F.col("id") == target).first()
    spark = vertices.sparkSession
    if end is None:
        return spark.createDataFrame([], "path array<long>, cost double")
    near = dist.where(F.col("hops") <= end["hops"])
    light = F.broadcast if near.count() <= model.LIGHT else lambda df: df
    one, two = near.select(F.col("id").alias("src"), F.col("distance").alias("ds"), F.col("hops").alias("hs")), near.select(F.col("id").alias("dst"), F.col("distance").alias("dd"), F.col("hops").alias("hd"))
    tight = arcs.join(light(one), "src").join(light(two), "dst").where("ds + w = dd and hs + 1 = hd")
    jump = checkpointed(tight.groupBy(F.col("dst").alias("x")).agg(F.min("src").alias("to")))
    own = checkpointed(near.where(F.col("id") == target).select("id", "hops"))
    for _ in range(int(end["hops"]).bit_length()):
        ahead = own.join(jump, F.col("id") == F.col("x")).select(F.col("to").alias("id")).join(near, "id").select("id", "hops")
        own = checkpointed(own.union(ahead))
        further = jump.select(F.col("x").alias("mid"), F.col("to").alias("end"))
        jump = checkpointed(jump.join(further, F.col("to") == F.col("mid")).select("x", F.col("end").alias("to")))
    path = F.transform(F.array_sort(F.collect_set(F.struct("hops", "id"))), lambda s: s["id"])
    return own.agg(path.alias("path")).select("path", F.lit(float(end["distance"])).alias("cost"))


def spanning_tree(vertices: DataFrame, edges: DataFrame, forest: bool = False) -> DataFrame:
    """(source, target, weight): least spanning tree of the component of the least vertex (or of all), in Boruvka rounds.

    Directions are ignored, missing weights are 1. Ties go to the lesser ends, so that rounds never close a cycle. Each
    round contracts what its edges join: only the least edge between two contracted vertices goes on.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weights(edges).alias("w"))
    cross = checkpointed(pairs.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")))
    tree: DataFrame | None = None
    while not cross.isEmpty():
        ends = cross.select("x", "e").unionByName(cross.select(F.col("y").alias("x"), "e"))
        best = checkpointed(ends.groupBy("x").agg(F.min("e").alias("e")))
        tree = checkpointed(best.select("e").distinct() if tree is None else tree.union(best.select("e").distinct()))
        joined = cross.join(best.select("e").distinct(), "e", "left_semi").select(F.col("x").alias("src"), F.col("y").alias("dst"))
        names = checkpointed(components(ends.select(F.col("x").alias("id")).distinct(), joined))
        moved = cross.join(names.select(F.col("id").alias("x"), F.col("componentId").alias("p")), "x").join(names.select(F.col("id").alias("y"), F.col("componentId").alias("q")), "y").where("p <> q")
        cross = checkpointed(moved.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("e").alias("e")))
    if tree is None:
        return vertices.sparkSession.createDataFrame([], "source long, target long, weight double")
    tree = tree.select("e.a", "e.b", "e.w")
    if not forest:
        first = vertices.agg(F.min("id")).first()[0]
        comp = components(vertices, tree.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        tree = tree.join(comp.where(F.col("componentId") == first).select(F.col("id").alias("a")), "a", "left_semi")
    return tree.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("w").alias("weight"))


def max_flow(edges: DataFrame, source: int, sink: int) -> DataFrame:
    """(max_flow): shortest augmenting paths over capacities (``weight``, 1 where missing) summed per pair.

    Augmentation is sequential, so the aggregated network goes to one task, not to the driver.
    """
    net = edges.where("src <> dst").select("src", "dst", weights(edges).alias("w")).where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def solve(pdf):
        import pandas as pd

        rest: dict[int, dict[int, float]] = {}
        for a, b, c in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["w"].tolist(), strict=True):
            rest.setdefault(a, {})[b] = rest.get(a, {}).get(b, 0.0) + c
            rest.setdefault(b, {}).setdefault(a, 0.0)
        total = 0.0
        while source != sink:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                u = queue.popleft()
                for v, c in rest.get(u, {}).items():
                    if c > 1e-12 and v not in came:
                        came[v] = u
                        queue.append(v)
            if sink not in came:
                break
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            least = min(rest[a][b] for a, b in path)
            for a, b in path:
                rest[a][b] -= least
                rest[b][a] += least
            total += least
        return pd.DataFrame({"max_flow": [total]})

    found = net.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "max_flow double")
    return found.unionByName(net.sparkSession.createDataFrame([(0.0,)], "max_flow double")).agg(F.max("max_flow").alias("max_flow"))


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(component, explained, loadings): from the covariance, whose blocks Spark sums in the JVM; signs make the largest loading positive.

    Rows with a null among the columns are left out.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    out = []
    for r in range(k):
        v = [float(model.pc[i, r]) for i in range(len(columns))]
        sign = 1 if max(v, key=abs) > 0 else -1
        out.append((r, float(model.explainedVariance[r]), [sign * x for x in v]))
    return df.sparkSession.createDataFrame(out, "component int, explained double, loadings array<double>")


def ranked(df: DataFrame, key: str, by: str, k: int) -> DataFrame:
    """The k rows per key with the greatest ``by``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc()))).where(F.col("_r") <= k).drop("_r")
