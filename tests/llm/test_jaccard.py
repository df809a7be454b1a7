import random

import numpy as np

import corpus_pipeline
from lattica.llm import jaccard
from tests.llm.helpers import documents, words


def brute(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The least id of each component at a similarity of 0.8 or more."""
    sets = [brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(least.values())


def near_rows():
    rng, rows = random.Random(11), []
    for k in range(30):
        w = words(300, 900 + k)
        for n in (0, 2, 4, 6, 7, 9, 14, 30):  # 0.97 to 0.3
            v = list(w)
            for at in rng.sample(range(300), n):
                v[at] = f"other{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(v)))
    return [*rows, (2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a b c")]


def test_near_documents_go_as_brute_force_says(spark):
    rows = near_rows()
    got = corpus_pipeline.drop_near(spark, documents(spark, rows), "")
    want = brute_kept(rows)
    assert 30 < len(want) < len(rows) - 60
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_an_empty_table_and_long_texts(spark):
    assert corpus_pipeline.drop_near(spark, documents(spark, []), "").collect() == []
    own = jaccard.shingles(" ".join(words(9000, 1)).encode())
    assert jaccard.bands(own) == jaccard.bands(own, 500) and len(set(jaccard.bands(own))) == jaccard.BANDS


def test_sketches_drop_unlike_sets_alone(spark):
    """Sets of similarity 0.8 stay, those of 0.4 go; bands meet as often as the formula says."""
    rng, rows, pairs, met = np.random.default_rng(5), [], [], 0
    for k in range(400):
        shared = 72 if k % 2 else 36  # of 90
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2) + np.uint64(k & 1)
        one, two = np.unique(a[: shared + (90 - shared) // 2]), np.unique(np.concatenate([a[:shared], a[shared + (90 - shared) // 2 :]]))
        rows += [(2 * k, bytearray(jaccard.sketch(jaccard.minima(one)))), (2 * k + 1, bytearray(jaccard.sketch(jaccard.minima(two))))]
        pairs.append((2 * k, 2 * k + 1))
        met += len(set(jaccard.bands(one)) & set(jaccard.bands(two))) if k % 2 else 0
    got = {r["u"] // 2 for r in jaccard.plausible(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(rows, "node long, sketch binary")).collect()}
    assert {k for k in range(400) if k % 2} <= got and len(got) < 205
    assert abs(met / 200 / jaccard.BANDS - 0.8**5) < 0.05


def test_rows_without_an_id_and_rows_that_share_one_stay_apart(spark):
    own = [" ".join(words(50, 70 + k)) for k in range(5)]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (4, own[2], "b"), (4, own[2], "a"), (4, own[3]), (None, own[3]), (9, own[4]), (None, None), (None, "")]
    for given in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["text"] or "", r["source"]) for r in corpus_pipeline.drop_near(spark, documents(spark, given), "").collect()), key=str)
        assert got == sorted([(None, own[0], "s"), (None, own[1], "s"), (4, own[2], "a"), (4, own[3], "s"), (9, own[4], "s"), (None, "", "s")], key=str)


def test_the_rings_name_all_candidates(spark, monkeypatch):
    """The stage compares what the SimHash operator names and nothing else."""
    rows, seen = near_rows(), []
    monkeypatch.setattr(jaccard, "candidates", lambda codes: seen.append(codes.columns) or codes.selectExpr("node as u", "node as v").limit(0))
    got = corpus_pipeline.drop_near(spark, documents(spark, rows), "").collect()
    assert seen == [["node", "code"]] and len(got) == len({frozenset(brute(t)) for _, t in rows})


def test_groups_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = near_rows()
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, documents(spark, rows), "").collect()) == brute_kept(rows)
