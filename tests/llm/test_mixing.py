import hashlib
from collections import defaultdict

import pytest

from lattica.llm import mixing
from tests.llm.helpers import documents, words


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


ROWS = [(k, " ".join(words(20 + k % 9, k)), s) for k, s in enumerate(["a"] * 150 + ["b"] * 5 + ["C"] * 40 + [None] * 3 + ["é"] * 10 + ["empty"])] + [(900, None, "a"), (901, "", "b"), (902, "   ", "only"), (None, "no id here", "a"), (3, "again", "a")]


def test_mix_against_brute_force(spark):
    out = mixing.mix(documents(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in out:
        n = len((r["text"] or "").split())
        assert r["size"] == n and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        u = int(hashlib.md5(f"mix-1:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["copies"] == int(rate) + (u < rate - int(rate)) and r["copies"] <= 3
        assert r["score"] == "x"  # other columns stay


def test_taken_words_come_near_the_targets_and_reruns_agree(spark):
    rows = [(k, " ".join(words(50, k)), f"s{k % 4}" if k % 3 else "s0") for k in range(3000)]
    docs = documents(spark, rows)
    one = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    again = mixing.mix(docs.repartition(7)).collect()
    assert one == {r["doc_id"]: r["copies"] for r in again}
    taken, target = defaultdict(int), {}
    for r in again:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.12)
    emitted = mixing.emit(mixing.mix(docs)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in emitted} == {k: v for k, v in one.items() if v}


def test_native_plan_and_nothing(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    plan = mixing.mix(documents(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
