import numpy as np

from lattica.llm import embeddings


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    link[i].append(j)
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[rows[i][0]] = (len(link[i]), min(rows[k][0] for k in seen), rows[i][0] == min(rows[k][0] for k in seen))
    return out


def cloud(seed=0, d=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(20):
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 8)):
            rows.append((1000 - 3 * k, [float(x) for x in base + rng.normal(0, rng.choice([0.05, 0.25, 0.3]), d)]))
            k += 1
    rows += [(2000 + k, rows[0][1]) for k in range(5)] + [(3000, None), (3001, [0.0] * d), (3002, []), (3003, [float("nan")] * d), (3004, [None] * d), (3005, [1.0] * (d - 1)), (3006, [2.0] * (d - 1)), (3007, [float("inf")] + [1.0] * (d - 1)), (3008, [-x for x in rows[0][1]])]
    rows += [(3010, [2 * x for x in rows[0][1]]), (3011, [1e-30 * x for x in rows[3][1]])]
    return rows


def test_links_against_brute_force(spark):
    rows = cloud()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'x' as n_links", "2 as rep")
    want = brute(rows)
    for block in (4096, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df, block=block).collect()}
        assert got == want


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    for d in (1, 33, 3000):  # the last beyond what one exact product holds
        x = rng.normal(size=(200, d)) * rng.choice([1, 30], size=d)
        x[0] = 0
        x[0, 0] = 1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = embeddings.quantise(x)
        for k in range(2):
            y = sum(c.q[m] * c.s[m][:, None] for m in range(k + 1))
            slack = c.n[k][:, None] * c.e[k][None, :] + c.n[k][None, :] * c.e[k][:, None] + c.e[k][:, None] * c.e[k][None, :]
            assert (np.abs(x @ x.T - y @ y.T) <= slack + 1e-12).all()
        assert c.e[1].max() < 0.01 * max(c.e[0].max(), 1e-9) + 1e-12


def test_sure_pairs_link_and_no_pair_is_missed():
    rng = np.random.default_rng(4)
    for d in (24, 1500):
        base = rng.normal(size=(40, d))
        x = np.concatenate([base, *(base + rng.normal(0, s, base.shape) for s in (0.2, 0.32, 0.33, 0.34, 0.5))])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cosine = x @ x.T
        for threshold in (0.95, float(np.sort(cosine[:40, 40:].ravel())[-60])):
            c = embeddings.quantise(x)
            got = {(int(i), int(j)): bool(s) for a, b, sure in embeddings.linked_pairs(c, c, threshold, block=64) for i, j, s in zip(a, b, sure, strict=True)}
            want = set(map(tuple, np.argwhere(cosine >= threshold + 1e-12).tolist()))
            assert want <= set(got) and all(cosine[p] >= threshold - 1e-9 for p, s in got.items() if s)
            assert all(abs(cosine[p] - threshold) < 1e-3 for p, s in got.items() if not s)


def test_pairs_at_the_threshold_are_settled_in_double_precision(spark):
    """Vectors whose cosine is the threshold to within rounding stay open in the tiles."""
    import math

    rows = [(0, [1.0, 0.0])]
    rows += [(k + 1, [0.95 + d, math.sqrt(1 - (0.95 + d) ** 2)]) for k, d in enumerate((0, 1e-15, -1e-15, 1e-12, -1e-12, 1e-7, -1e-7))]
    rows += [(k + 20, v) for k, (_, v) in enumerate(rows[1:4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    norm = np.array([np.linalg.norm(v) for v in x])
    want = [sum(i != j and float(x[i] @ x[j] / (norm[i] * norm[j])) >= 0.95 for j in range(len(rows))) for i in range(len(rows))]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df).collect()}
    assert [got[k] for k, _ in rows] == want


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (9, [0.0, 1.0]), (None, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"] is None, r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()), key=str)
    assert [(g[1], g[2]) for g in got] == [(5, 1), (5, 1), (9, 0), (None, 0)]
    assert embeddings.near_vectors(df.limit(0)).collect() == []
