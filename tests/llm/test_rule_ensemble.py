import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import rule_ensemble as r
from tests.llm.helpers import documents, text


def corpus(n=240):
    good = [(k, text(80 + k % 50, k), "s") for k in range(n)]
    bad = [(n + k, " ".join(w + "%%%" for w in text(60, 900 + k).split()) if k % 2 else "\n".join(["same again here"] * (20 + k % 9)), "s") for k in range(n // 4)]
    return good + bad, [(d, 1, 0) for d, _, _ in good] + [(d, 0, 0) for d, _, _ in bad]


def test_statistics_of_odd_texts():
    for t in (b"", b" \n\t", b"a", b"\n\nx\n", "é ü 日本".encode(), b"a b", b"word " * 50_000):
        v = r.statistics(t)
        assert len(v) == len(r.STATS) and np.isfinite(v).all()
    assert r.statistics(b"") == [0.0] * len(r.STATS)
    v = dict(zip(r.STATS, r.statistics(b"a b a b\na b a b\nx | y"), strict=True))
    assert v["n_words"] == 11 and v["dup_lines"] == pytest.approx(1 / 3) and v["bars"] == pytest.approx(1 / 11) and v["top_word"] == pytest.approx(4 / 11)


def plain(t):
    """The statistics by counting words, lines and windows themselves."""
    words, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * len(r.STATS)
    n, solid, times = len(words), sum(c not in b" \t\n\v\f\r" for c in t), Counter(words)
    share = lambda chars: sum(c in chars for c in t) / n
    upper, lower = (sum(a <= c <= z for c in t) for a, z in ((65, 90), (97, 122)))
    windows = {tuple(words[k : k + 3]) for k in range(n - 2)} or {()}
    return [
        n, solid / n, max(map(len, words)), share(b"#*$%&<>@^~="), share(b"!?"), share(b"|"), sum(48 <= c <= 57 for c in t) / solid, upper / max(1, upper + lower), share(b",;:"), share(b"."), share(b"()[]{}\"'/\\_-+`"),
        sum(c >= 128 for c in t) / solid, n / len(lines), sum(x.rstrip()[-1] in b".!?" for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), 1 - sum(map(len, set(lines))) / sum(map(len, lines)),
        len(times) / n, max(times.values()) / n, 1 - len(windows) / max(1, n - 2), sum(65 <= w[0] <= 90 for w in times) / len(times),
    ]


def test_statistics_against_plain_counting():
    rng = random.Random(6)
    bits = ["a", "b", "Ab", "x.", "é", "%", "|", "\n", " ", "\n", " ", "12", "(", "\t", "Zz!"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(80))).encode()
        assert r.statistics(t, part=7) == pytest.approx(plain(t)) and r.statistics(t) == pytest.approx(plain(t)), t


def test_trees_and_lasso_against_brute_force():
    """The first split is the best of all, and no change of one weight lowers the penalised loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)).round(1)
    y = (x[:, 1] + 0.3 * rng.normal(size=200) > 0.4).astype(float)
    cuts = [np.unique(x[:, f])[:-1] for f in range(3)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    grad, hess = np.full(200, 0.5) - y, np.full(200, 0.25)
    paths, _ = r._tree(bins, cuts, grad, hess, 1, 5)

    def gain(f, t):
        high = x[:, f] > t
        if min(high.sum(), (~high).sum()) < 5:
            return 0
        return sum(grad[side].sum() ** 2 / (hess[side].sum() + 1) for side in (high, ~high))

    assert gain(*[(f, t) for ((f, _, t),) in paths][0]) == pytest.approx(max(gain(f, t) for f in range(3) for t in cuts[f]))
    model = r.train(x, y, trees=3, depth=2, penalty=0.01)

    def loss(bias, weights):
        m = np.stack([r.holds(x, rule) for rule, _ in model.rules], axis=1).astype(float)
        z = bias + m @ weights
        return np.mean(np.log1p(np.exp(-z)) + (1 - y) * z) + 0.01 * np.abs(weights * np.maximum(m.std(axis=0), 0.02)).sum()

    w = np.array([a for _, a in model.rules])
    least = loss(model.bias, w)
    for k in range(len(w)):
        for d in (-0.05, 0.05):
            assert loss(model.bias, w + d * np.eye(len(w))[k]) > least - 1e-5


def test_learns_and_compiles(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + [(9000, None), (9001, ""), (9002, text(30_000, 1)), (None, "x y")])
    model = r.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 4] + [(9000, None, None), (77777, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert 0 < len(model.rules) < 200
    scored = r.score_quality(docs, model).collect()
    assert len(scored) == len(rows) + 4 and all(0 <= x["score"] <= 1 for x in scored)
    truth = {d: y for d, y, _ in labels}
    held = [(x["score"], truth[x["doc_id"]]) for x in scored if x["doc_id"] in truth and x["doc_id"] % 4 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    measured = r.measured(docs).collect()
    x = np.array([[m[f"_stat_{k}"] for k in range(len(r.STATS))] for m in measured])
    compiled = [c[0] for c in r.measured(docs).select(model.column([F.col(f"_stat_{k}") for k in range(len(r.STATS))])).collect()]
    assert np.allclose(model.score(x), compiled)


def test_without_labels_or_documents(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x["score"] for x in r.score_quality(docs, r.fit(docs, none)).collect()] == [0.5, 0.5]
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(x["score"] > 0.9 for x in r.score_quality(docs, r.fit(docs, only)).collect())
    assert r.score_quality(docs.limit(0), r.RuleModel(0.0, ())).collect() == []
