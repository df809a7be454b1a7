import random
import re
from collections import Counter

from lattica.llm import quality_rules as q
from tests.llm.helpers import documents, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(win)
    covered = {k + d for k, x in enumerate(win) if n[x] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "a b c d a b c", "x y z q x y z", "é ü # $$ | <>\n\nline\nline\n line\n", "😀 a\x0bb\x0cc\rd", text(3000, 3), "\n".join(["same line here again"] * 40), text(100, 1) + "\n" + text(100, 1)]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "É"]) for _ in range(rng.randint(0, 300))))
    return out


def test_measurements_against_brute_force(spark):
    texts = corpus()
    book = q.ledger(documents(spark, list(enumerate(texts)))).collect()
    assert len(book) == len(texts)
    for r in book:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert bool(r["fails"] & q.BASE.mask) == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_policies_and_ablations(spark):
    book = q.ledger(documents(spark, [(k, t) for k, t in enumerate(corpus())] + [(0, None)])).cache()
    rows = book.collect()
    for p in q.POLICIES.values():
        assert {(r["doc_id"], r["kept"]) for r in q.apply_policy(book, p).collect()} == {(r["doc_id"], r["fails"] & p.mask == 0) for r in rows}
        for a in q.ablations(book, p).collect():
            bit = q.BIT[a["rule"]]
            assert a["fails"] == sum(bool(r["fails"] & bit) for r in rows)
            assert a["only"] == sum(r["fails"] & p.mask == bit for r in rows)
    assert q.ledger(documents(spark, [])).collect() == [] and q.ablations(q.ledger(documents(spark, [])), q.BASE).collect() == []
    plan = book._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_junk_goes_and_prose_stays(spark):
    prose = text(800, 2)
    rows = {1: prose, 2: "word%%% more*** and### then$$$ " * 60, 3: "ALL OF THIS IS SHOUTING! " + " ".join(f"LOUD{'X' * (k % 7)}Y" for k in range(200)), 4: "short text"}
    got = {r["doc_id"]: r["kept"] for r in q.apply_policy(q.ledger(documents(spark, list(rows.items()))), q.POLICIES["v2"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
