import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import packing
from lattica.llm.queries import tokenizer_path
from tests.llm.helpers import documents, text

TEXTS = ["", "one", "don't STOP 's I'LL", "<|endoftext|> a<|startoftext|>b", "\x01 a\x01b \x7f", "ΑΣ ΑΣ. İstanbul ẞ é ́a", "日本語 テスト x y \x85z \x1cq", "12 3.5 $$$%%% a|b", "😀😀 👍🏽", "ÉCOLE À côté"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizers_library(whole):
    rng = random.Random(5)
    odd = ["".join(chr(rng.choice([rng.randint(1, 126), rng.randint(161, 0x24F), rng.randint(0x300, 0x36F), rng.randint(0x370, 0x3FF), 0x1F600 + rng.randint(0, 60)])) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts = TEXTS + odd + [text(300, k) for k in range(5)]
    small = packing.WordTokenizer(tokenizer_path(), most=40)  # the table starts anew again and again
    got = [list(map(int, ids)) for t in texts for ids in small.texts([t.encode()])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_tokenized_in_parts(whole):
    t = text(3000, 1)
    parts = list(packing.long_parts(t.encode(), 500))
    assert b"".join(parts) == t.encode() and max(map(len, parts)) <= 500
    joined = [int(i) for ids in packing.tokenizer(tokenizer_path()).texts(parts) for i in ids]
    assert joined == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_packs_everything_and_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(25)}
    bins = packing.bin_completion(counts, 100)
    used = Counter()
    for pattern, times in bins:
        assert sum(pattern) <= 100 and times > 0
        for s in pattern:
            used[s] += times
    assert used == Counter(counts)
    assert sum(n for _, n in bins) <= sum(n for _, n in packing.best_fit(counts, 100))


def fewest(sizes, room):
    """Bins that an exhaustive search needs."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for held in set(bins):
            if held + sizes[k] <= room:
                i = bins.index(held)
                place(k + 1, [*bins[:i], held + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal():
    beaten = 0
    for seed in range(400):
        rng = random.Random(seed)
        room = rng.choice([10, 20, 30, 50, 100])
        low = rng.choice([1, room // 5 + 1, room // 4])
        sizes = [rng.randint(low, room if rng.random() < 0.3 else room * 2 // 3) for _ in range(rng.randint(1, 11))]
        counts, best = Counter(sizes), fewest(sizes, room)
        assert packing.bound(counts, room) <= best == sum(n for _, n in packing.bin_completion(dict(counts), room, steps=10**6))
        beaten += sum(n for _, n in packing.best_fit(counts, room)) > best
    assert beaten


def test_bin_completion_solves_planted_packings():
    """Ten bins that three pieces each fill exactly: best-fit decreasing misses nearly all of them."""
    for seed in range(30):
        rng, sizes = random.Random(seed), []
        for _ in range(10):
            a = rng.randint(100, 500)
            b = rng.randint(100, 900 - a)
            sizes += [a, b, 1000 - a - b]
        assert sum(n for _, n in packing.bin_completion(Counter(sizes), 1000)) == 10
        assert sum(n for _, n in packing.best_fit(Counter(sizes), 1000)) > 10


def test_fillings_are_undominated_and_complete():
    """Against all sub-multisets: what is left out is dominated by one piece in place of some, or has room for another."""
    rng = random.Random(9)
    for _ in range(200):
        left = Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 7)))
        room, sizes = rng.randint(1, 20), sorted(left, reverse=True)
        got = {tuple(sorted(f)): w for f, w in packing.fillings(left, sizes, room, room)}
        every = set()
        for take in itertools.product(*(range(left[s] + 1) for s in sizes)):
            f = tuple(sorted(s for s, n in zip(sizes, take, strict=True) for _ in range(n)))
            if sum(f) <= room:
                every.add(f)
        assert set(got) <= every and all(sum(f) + w == room for f, w in got.items()) and got
        for f in every - set(got):
            waste, rest = room - sum(f), left - Counter(f)
            parts = {p for k in range(len(f) + 1) for p in itertools.combinations(f, k)}
            assert any(sum(p) <= x <= sum(p) + waste and (x,) != p for p in parts for x in rest), (left, room, f)


def test_bin_completion_of_nothing():
    assert packing.bin_completion({}, 10) == [] and packing.bin_completion({3: 0}, 10) == []


def test_pack(spark, whole):
    rows = [(k, text(30 + 37 * k % 900, k)) for k in range(60)] + [(100 + k, "same words here") for k in range(50)] + [(None, None), (200, None), (201, ""), (202, text(9000, 99)), (7, text(30 + 37 * 7 % 900, 7))]
    out = packing.pack(packing.pieces(documents(spark, rows), tokenizer_path(), room=512), room=512).collect()
    expected = Counter()
    for doc_id, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k, low in enumerate(range(0, len(ids), 512)):
            part = ids[low : low + 512]
            expected[doc_id, k, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= sum(n for _, n in packing.best_fit(Counter(r["length"] for r in out), 512))


def test_pack_of_nothing(spark):
    assert packing.pack(packing.pieces(documents(spark, []), tokenizer_path())).collect() == []
