import math
import tracemalloc

import numpy as np

from lattica.llm import toxicity as t
from tests.llm.helpers import documents, words


def test_gradients():
    some = [b"abc", b"idiot", b"x", b"hello", b"zz"]
    net = t.Network.fresh(np.unique(t.features(some)[0])[::2], 1)  # every second feature has an embedding
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    row, start = net.rows(some)
    index, size, y = np.array([[0, 1, 2], [3, 4, 0], [1, 0, 0]]), np.array([3, 2, 3]), np.array([1, 0, 1])

    def loss():
        logit = net.logits(net.gates(np.add.reduceat(net.p["e"][row], start, axis=0)), index, size).astype(float)
        p = t.sigmoid(logit)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(row, start, index, size, y, np.ones(3))
    for name in ("uf", "ub", "wf", "wb", "bf", "bb", "a", "o", "c"):
        at = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-3 * max(1e-2, abs(g[name][at])) + 2e-6, name


def plain_logit(net, words):
    """The network word by word and unit by unit, after its definition."""
    p, k, sig = {n: v.astype(float) for n, v in net.p.items()}, t.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    vectors = []
    for w in words:
        row, _ = net.rows([w])
        vectors.append([sum(p["e"][r][i] for r in row) for i in range(t.WIDTH)])
    states = {}
    for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        h = [0.0] * k
        for at in order:
            x = [sum(vectors[at][i] * p[f"w{d}"][i][j] for i in range(t.WIDTH)) + p[f"b{d}"][j] for j in range(3 * k)]
            y = [sum(h[i] * p[f"u{d}"][i][j] for i in range(k)) for j in range(3 * k)]
            z, r = ([sig(x[o + j] + y[o + j]) for j in range(k)] for o in (0, k))
            new = [math.tanh(x[2 * k + j] + r[j] * y[2 * k + j]) for j in range(k)]
            h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(k)]
            states[d, at] = h
    both = [states["f", at] + states["b", at] for at in range(len(words))]
    weight = [math.exp(sum(a * b for a, b in zip(p["a"], h, strict=True))) for h in both]
    pooled = [sum(w * h[j] for w, h in zip(weight, both, strict=True)) / sum(weight) for j in range(2 * k)]
    return sum(a * b for a, b in zip(p["o"], pooled, strict=True)) + p["c"][0]


def test_forward_pass_against_the_definition():
    net = t.Network.fresh(np.arange(0, t.BUCKETS, 2), 5)
    net.p = {n: 3 * v for n, v in net.p.items()}
    scorer = t.Scorer(net)
    for n in (1, 3, 32, 57, 90):
        own = " ".join(words(n, 40 + n)).encode().split()
        want = max(plain_logit(net, own[a:b]) for a, b in t.windows(n))
        assert abs(math.log(1 / scorer.scores([b" ".join(own)])[0] - 1) + want) < 1e-3


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    some = [b"a", b"ab", b"abc", b"abcdef", "é".encode(), b"x" * 40]
    bucket, start = t.features(some)
    for k, w in enumerate(some):
        own, _ = t.features([w])
        assert own.tolist() == bucket[start[k] : [*start[1:], len(bucket)][k]].tolist() and len(own) == len(w) + max(0, len(w) - 2) + 1


def test_windows_cover_every_word():
    for n in (1, 2, 31, 32, 33, 40, 56, 57, 500, 1001):
        spans = t.windows(n)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(n)) and all(b - a <= t.WINDOW for a, b in spans)
    assert t.windows(0) == []


def test_scorer_equals_the_windows_one_by_one():
    net = t.Network.fresh(np.arange(0, t.BUCKETS, 2), 3)
    scorer = t.Scorer(net, most=50)
    texts = [" ".join(words(n, n)).encode() for n in (1, 5, 31, 32, 33, 39, 40, 41, 56, 57, 100, 333)] + [b"", b" \n", "É ü".encode()]
    got = scorer.scores(texts)
    for text, score in zip(texts, got, strict=True):
        w = text.translate(t.LOWER_AZ).split()
        one = []
        for a, b in t.windows(len(w)):
            grid, size = t.lay_out([np.arange(b - a)])
            one.append(net.logits(net.gates(net.word_vectors(w[a:b])), grid, size)[0])
        want = t.sigmoid(np.float64(max(one))) if one else t.sigmoid(np.float64(net.p["c"][0]))
        assert abs(score - want) < 1e-5


def corpus():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(260):
        w = words(60 + k % 200, k)
        y = int(k % 4 == 0)
        for _ in range(4 * y):
            w[rng.integers(len(w))] = rng.choice(["vilething", "vileword", "badvile"]) + rng.choice(["", ",", "."])
        rows.append((k, " ".join(w)))
        labels.append((k, y))
    return rows, labels


def test_learns_and_scores_all_rows(spark):
    rows, labels = corpus()
    docs = documents(spark, [*rows, (1000, None), (1001, ""), (None, "some words"), (1002, " ".join(words(20_000, 5)) + " vileword"), (3, rows[3][1])])
    net = t.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 5] + [(1000, None), (4, 1), (None, 1)], "doc_id long, toxic int"))
    out = t.score_texts(docs, net).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in out) and "text" not in out[0].asDict()
    by = {r["doc_id"]: r["score"] for r in out}
    held = [(by[k] >= 0.3, y) for k, y in labels if k % 5 == 0]
    assert np.mean([p == bool(y) for p, y in held]) > 0.9
    assert by[1002] >= 0.3  # far behind the start of a long text
    assert "text" in t.score_texts(docs, net, text=True).columns


def test_one_label_none_and_nothing(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    for labels, low in (([(1, 0), (2, 0)], True), ([], True), ([(1, 1)], False)):
        net = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all((r["score"] < 0.3) == low for r in t.score_texts(docs, net).collect())
    assert t.score_texts(docs.limit(0), t.Network.fresh(np.arange(0))).collect() == []


def test_training_holds_numbers_and_not_words():
    """The driver trains: of 200,000 different words it holds numbers and rows, not copies and working arrays of all at once."""
    docs = ((k % 2, [[b"word%06d" % (32 * (20 * k + w) + i) for i in range(32)] for w in range(20)]) for k in range(310))
    tracemalloc.start()
    t.train(docs, rounds=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6  # all at once: 287 MB


def test_blocks_of_words_have_the_same_features():
    some = [b"w%d" % (k * k) for k in range(50)]
    for got, want in zip(t.features_in_blocks(some, 7), t.features(some), strict=True):
        assert got.tolist() == want.tolist()
    assert [len(x) for x in t.features_in_blocks([])] == [0, 0]


def test_the_length_of_a_window_is_not_learned():
    """Words that don't tell the labels apart give every text the share of the label, however short its last window is."""
    rows = [(int(k == 3), [b" ".join(b"u%d" % (1000 * k + i) for i in range(a, b)).split() for a, b in t.windows(n)]) for k, n in enumerate((5000, 30, 5006, 60))]
    got = t.Scorer(t.train(rows)).scores([b"", b"a b c", b"u1 " * 60, b"u1 " * 5006])
    assert np.allclose(got, 0.25, atol=1e-6)
