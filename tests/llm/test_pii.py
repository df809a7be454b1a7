import hashlib
import itertools
import random
import re

import numpy as np

from lattica.llm import pii
from tests.llm.helpers import documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in pii.IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in pii.CARD.finditer(text) if 14 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), m.end(), 3) for m in pii.PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    bits = ["a.b@c.d", "@", "x@y", "e@f.g@h.i", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+49 30 1234567", "+", "12", "é", " ", "\n", ".", "-", "0001.2.3.4", "٣٤", "a..b@c..d", "x%+-@a-b.c-d."]
    for _ in range(3000):
        t = "".join(rng.choice(bits) + rng.choice(["", " ", "", "x"]) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_marginals_are_exact_without_loops():
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, pii.N_LABELS)), rng.normal(size=(pii.N_LABELS,) * 2), rng.normal(size=(pii.N_LABELS,) * 2))
    x = rng.normal(size=(4, pii.N_FEATURES))
    t = pii.Tokens(np.zeros((4, 2), int), x, np.array([[0, 1], [1, 2]]), np.array([[1, 3]]), np.zeros(4, bool))
    unary, want = x @ field.unary, np.zeros((4, pii.N_LABELS))
    for ys in itertools.product(range(pii.N_LABELS), repeat=4):
        p = np.exp(sum(unary[k, y] for k, y in enumerate(ys)) + sum(field.chain[ys[a], ys[b]] for a, b in t.chain) + sum(field.skip[ys[a], ys[b]] for a, b in t.skip))
        for k, y in enumerate(ys):
            want[k, y] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii.marginals(field, t, rounds=60), want, atol=1e-6)


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(300):
        w = [f"w{rng.randrange(500)}" if rng.random() < 0.02 else rng.choice(["and", "the", "of", "in"]) for _ in range(60)]
        kind = k % 5
        pick = {0: f"u{rng.randrange(99)}@mail{rng.randrange(9)}.org", 1: ".".join(str(rng.randrange(256)) for _ in range(4)), 2: "4111111111111111", 3: f"+1 ({rng.randrange(200, 999)}) 555-0{rng.randrange(100, 999)}", 4: "plain"}[kind]
        w.insert(rng.randrange(60), pick)
        rows.append((k, " ".join(w)))
    return rows


def test_find(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "no digits"), (902, "no digits"), (903, "😀 a.b@c.de and +1 (415) 555-0100 then (415) 555-0100."), (None, "1.2.3.4"), (904, "7 " * 20_000 + "10.0.0.1")]
    docs = documents(spark, rows)
    field = pii.fit(docs)
    out = pii.find(docs, field).collect()
    assert len(out) == len(rows)
    texts = {}
    for k, t in rows:
        texts[k] = t or ""
    for r in out:
        base = brute(texts[r["doc_id"]])
        assert r["base"] == pii.written(base)
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[2] == k for s in base) for k in range(4))
        everything = set(filter(None, r["spans"].split(",")))
        assert r["n_all"] == len(everything) + len([x for x in r["secrets"].split(",") if x])
        assert set(filter(None, r["base"].split(","))) <= everything
        for s in everything:
            kind, low, high = s.split(":")
            assert kind in pii.KINDS and 0 <= int(low) < int(high) <= len(texts[r["doc_id"]])


def test_skip_edges_carry_a_label_to_a_likeness():
    """A token that looks like nothing alone takes the label of the token it repeats."""
    unary = np.zeros((pii.N_FEATURES, pii.N_LABELS))
    unary[7, 4] = 8.0  # a leading plus: phone
    skip = np.full((pii.N_LABELS,) * 2, -1.0) + 4 * np.eye(pii.N_LABELS)
    field = pii.Field(unary, np.zeros((pii.N_LABELS,) * 2), skip)
    text = "call +14155550100 soon or 4155550100 then"
    base, everything = pii.all_spans(text, field)
    assert [s for s in everything if s not in base] == [(26, 36, 3)]


def test_the_field_finds_what_the_patterns_miss(spark):
    """Trained on half of a corpus with planted secrets and numbers side by side, held out on the other half."""
    rng = random.Random(8)
    rows, truth = [], {}
    for k in range(400):
        w = [rng.choice(["and", "the", "of", "in", "Version 2.0.", "CC BY-NC 4.0.", "page 12"]) for _ in range(50)]
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        card = next(c for c in (f"4{rng.randrange(10**15):015d}" for _ in itertools.count()) if pii.luhn(c))
        planted = [[f'token = "{hexes}"'], [f"password={hexes[:18]}"], ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))], [phone], [card], [phone, card], []][k % 7]
        if planted:
            w[20:20] = planted
        rows.append((k, " ".join(w)))
        truth[k] = planted
    out = pii.find(documents(spark, rows[200:]), pii.fit(documents(spark, rows[:200]))).collect()
    caught = {r["doc_id"]: r["n_all"] for r in out}
    assert all(caught[k] >= len(truth[k]) for k in caught) and all(caught[k] == 0 for k in caught if not truth[k])
    both = [r for r in out if len(truth[r["doc_id"]]) == 2]
    assert both and all((r["n_card"], r["n_phone"]) == (0, 0) and [s.split(":")[0] for s in r["spans"].split(",")] == ["phone", "card"] for r in both)


def test_candidates_by_a_plain_scan():
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("ab1@ \n\"=+(.-Z9") for _ in range(rng.randrange(40)))
        plain = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D\"'=<>|]+", t) if re.search("[0-9@]", m[0])]
        assert pii.candidates(t) == plain
    assert pii.candidates("x ABCDEFGHIJKLMNOPQRST y") == [(2, 22)]
    assert len(pii.tokens_of("x" * 1_000_000 + " 1" + "9" * 300_000).span) == 1  # linear in the text


def test_query_digests_the_base_spans(spark, data):
    from lattica.llm import queries

    rows = queries.op9_pii(spark, data).collect()
    assert rows and all(r["base_sha256"] == hashlib.sha256(r["base"].encode()).hexdigest() for r in rows)


def test_nothing(spark):
    docs = documents(spark, [])
    assert pii.find(docs, pii.fit(docs)).collect() == []
