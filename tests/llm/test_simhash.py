import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lattica.llm import jaccard, simhash
from lattica.llm.components import joined
from tests.llm.helpers import documents, words


def brute_print(t, size=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = {k: k for k in range(len(ids))}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((x for x in groups[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_fingerprint_against_brute_force():
    for t in ("", "  \t\n", "One", "one TWO", "a b c d", "a b c d e", "É a É a É a", "x\x1cy z", " ".join(words(500, 1)), "  A B"):
        assert simhash.fingerprint(t.encode()) == brute_print(t), t
        assert simhash.fingerprint(t.encode(), 5) == brute_print(t, 5), t
    long = " ".join(words(40_000, 2))
    hashes = np.array([xxh64_intdigest(w.encode()) for w in long.split()], dtype=np.uint64)
    assert simhash.majority(hashes, block=1000) == simhash.majority(hashes)


def test_pigeonring_buckets_lose_no_link():
    rng = random.Random(1)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        keys = [set(simhash.buckets_of(np.array([x], dtype=np.uint64).view(np.int64))[0].tolist()) for x in (a, b)]
        common = keys[0] & keys[1]
        assert any(len(simhash.near(np.uint64(a), np.array([b], dtype=np.uint64), k >> 26)) for k in common)
        far = rng.getrandbits(64)
        assert bin(a ^ far).count("1") <= 4 or not any(len(simhash.near(np.uint64(a), np.array([far], dtype=np.uint64), s)) for s in range(5))


def _linked(spark, prints, block):
    df = spark.createDataFrame([(int(np.array(p, dtype=np.uint64).view(np.int64)),) for p in prints], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash.links(df, block).collect()]
    index = {int(np.array(p, dtype=np.uint64).view(np.int64)): k for k, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for u, v in edges:
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 4
        root[find(index[u])] = find(index[v])
    return [find(k) for k in range(len(prints))], len(edges)


def test_links_connect_what_brute_force_connects_in_blocks_too(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    want = brute_components(list(range(len(prints))), prints)
    for block in (16_384, 4):
        got, edges = _linked(spark, prints, block)
        canon = {}
        assert [canon.setdefault(g, k) for k, g in enumerate(got)] == want
        assert block < 100 or edges < 5 * 14 * len(prints)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(12):
        w = words(400, k)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "changed"
            rows.append((len(rows) * 7 % 1000, " ".join(v)))
    rows += [(2000 + k, " ".join(words(400, 0))) for k in range(30)]  # many copies
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "alone here"), (6000, "alone here"), (6000, "alone here"), (7000, "x")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [brute_print(t or "") for _, t in rows]
    want = Counter(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints), strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_ring_passes_the_pairs_within_the_budget_alone(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(600):
        x = 0
        for b in rng.sample(range(64), rng.randrange(40)):
            x |= 1 << b
        rows.append((x - (1 << 64) if x >> 63 else x, x.bit_count()))
    df = spark.createDataFrame(rows, "x long, n int")
    for bits in (4, 26):
        assert all(r["ok"] == (r["n"] <= bits) for r in df.select("n", simhash.ring(F.col("x"), bits).alias("ok")).collect())


def test_similar_sets_stay_within_the_wide_budget():
    """Sets of similarity 0.8 against the budget of the near-duplicate stage, unrelated ones beyond it for the most part."""
    rng = np.random.default_rng(3)
    for n in (9, 45, 450):
        far, apart = [], []
        for _ in range(300):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 9] = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64) * np.uint64(2)
            far.append((simhash.majority(a) ^ simhash.majority(b)).bit_count())
            apart.append((simhash.majority(a) ^ simhash.majority(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).bit_count())
        assert max(far) <= jaccard.BITS and np.mean(np.array(apart) > jaccard.BITS) > 0.8


def test_codes_against_brute_force():
    rng = np.random.default_rng(8)
    for n in (0, 1, 4, 255, 256, 5000):
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        got = simhash.code(own)
        assert simhash.code(own, 510).tolist() == got.tolist() and got.dtype == np.uint64
        for k in (0, 7, simhash.RINGS - 1):
            x = (own ^ simhash.MIX[k]) * simhash.BY[k]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            assert int(got[k]) == simhash.majority(x ^ (x >> np.uint64(29)))


def reached(edges):
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def test_candidates_are_what_meets_and_keeps_the_chains(spark):
    """Against every pair, bucket by bucket; small buckets, buckets above FEW and buckets dealt out in blocks alike."""
    rng = np.random.default_rng(9)
    flips = lambda share: np.packbits(rng.random((simhash.RINGS, 64)) < share, axis=1).view(np.uint64)[:, 0]
    base = [flips(0.5) for _ in range(9)]
    codes = [b ^ flips(0.1 if k % 2 else 0.3) for b in base[:8] for k in range(8)] + [base[8] ^ flips(0.04) for _ in range(150)]
    want = []
    for i, a in enumerate(codes):
        for j, b in enumerate(codes[:i]):
            x = a ^ b
            bits = np.bitwise_count(x)
            for k in range(simhash.RINGS):
                if bits[k] <= simhash.RING_BITS and int(bits[k]) + int(bits[(k + 1) % simhash.RINGS]) <= 2 * simhash.RING_BITS:
                    if any(int(x[k]) & simhash.MASKS[s] == 0 and len(simhash.near(np.uint64(0), x[k : k + 1], s, simhash.RING_BITS)) for s in range(5)):
                        want.append((i, j))
                        break
    rows = spark.createDataFrame([(k, bytearray(c.astype("<u8").tobytes())) for k, c in enumerate(codes)], "node long, code binary")
    for block in (16_384, 20):
        got = [(r["u"], r["v"]) for r in simhash.candidates(rows, block).collect()]
        assert reached(got) == reached(want) and len(got) < len(want)
    assert simhash.candidates(rows.limit(0)).collect() == []


def test_components_by_one_task_and_by_several(spark):
    rng = np.random.default_rng(10)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2)) if a != b] + [(k, k + 1) for k in rng.permutation(np.arange(1000, 1400)).tolist()]
    table = spark.createDataFrame(edges, "u long, v long").repartition(6)
    for most in (1 << 20, 200):
        assert {r["node"]: r["root"] for r in joined(table, most).collect()} == reached(edges)
    assert joined(table.limit(0)).collect() == []
