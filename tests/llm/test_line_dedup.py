import random

from lattica.llm import line_dedup as ld
from tests.llm.helpers import documents, text, words


def test_patience_pairs_are_equal_and_ascending():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert ld.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert ld.patience([9, 1, 2, 8], [1, 2, 7]) == [(1, 0), (2, 1)]
    assert ld.patience([], [1]) == []


def passage(seed, lines=4):
    return "\n".join(" ".join(words(15, seed * 10 + k, 10**6)) for k in range(lines))


def run(spark, rows):
    return sorted(((r["doc_id"], r["text"], r["n_deleted"]) for r in ld.dedup_lines(documents(spark, rows)).collect()), key=str)


def test_a_passage_stays_in_the_earliest_document_only(spark):
    p = passage(1)
    own = [text(60, 100 + k) for k in range(40)]
    rows = [(k, f"{own[k]}\n{p}\nend of {k} here") for k in range(40)] + [(99, text(50, 7))]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[0][1] == rows[0][1] and got[99][1] == rows[-1][1]
    for k in range(1, 40):
        assert got[k][1] == f"{own[k]}\nend of {k} here" and got[k][2] == 4


def test_short_blocks_stay_and_split_holders_are_found(spark):
    a, b = passage(3, 2), passage(4, 2)
    line = "a line that is common to all"
    rows = [(1, f"{line}\n{a}"), (2, f"{b}\n{line}"), (3, f"{line}\nmine own words\n{a}\n{b}"), (4, line)]
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[4] == line
    assert got[3] == f"{line}\nmine own words"


def test_every_passage_is_held_once(spark):
    rng = random.Random(5)
    pool = [passage(50 + k, 3) for k in range(15)]
    rows = []
    for k in range(60):
        parts = [text(24, 1000 + k)] + rng.sample(pool, 2)
        rows.append((k * 3 % 61, "\n".join(parts)))
    out = run(spark, rows)
    for p in pool:
        holders = [r[0] for r in rows if p in r[1]]
        left = [r[0] for r in out if p in r[1]]
        assert not holders or left == [min(holders)]
    assert sum(r[1].count("\n") + 1 for r in out) >= 60 * 2


def test_odd_rows(spark):
    p = passage(8)
    rows = [(None, p), (1, p), (1, p), (2, None), (3, ""), (4, "\n\n"), (5, p + "\n" + p), (6, "x")]
    got = run(spark, rows)
    by = {}
    for doc_id, t, n in got:
        by.setdefault(doc_id, []).append((t, n))
    assert by[None] == [(p, 0)] and by[1] == [("", 4), ("", 4)]  # null comes first
    assert by[2] == [(None, 0)] and by[3] == [("", 0)] and by[4] == [("\n\n", 0)] and by[6] == [("x", 0)]
    assert by[5][0][1] == 8  # both copies are held by the first document
    assert ld.dedup_lines(documents(spark, [])).collect() == []


def test_blocks_of_lines_first_held_one_by_one_go(spark):
    lines = passage(21, 4).split("\n")
    short = [f"t{k} u{k}" for k in range(12)]  # two words a line
    rows = [(k, f"{text(30, 300 + k)}\n{x}\nown end {k}") for k, x in enumerate(lines + short)]
    rows += [(50 + k, "\n".join([f"head of {k}", *lines, f"middle of {k}", *short])) for k in range(4)]
    rows += [(60 + k, f"start {k}\n{' '.join(words(25, 4))}\n{x}") for k, x in enumerate(["few words", "few words"])]
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert all(got[r[0]] == r[1] for r in rows[:17]) and got[60] == rows[-2][1]
    assert [got[50 + k] for k in (1, 2, 3)] == [f"head of {k}\nmiddle of {k}" for k in (1, 2, 3)] and got[61] == "start 1"


def test_every_line_of_a_block_lies_in_a_window_within_it():
    rng = random.Random(3)
    for _ in range(300):
        items = [{"ord": k, "words": rng.choice((1, 2, 5, 19, 20, 40))} for k in range(30) if rng.random() < 0.9]
        got = set(ld.windows(items, 20))
        for low in range(len(items)):
            for high in range(low + 1, len(items) + 1):
                block = items[low:high]
                if block[-1]["ord"] - block[0]["ord"] != len(block) - 1:
                    break
                if sum(x["words"] for x in block) >= 20:
                    assert {k for i, j in got if low <= i and j <= high for k in range(i, j)} == set(range(low, high))


def items(hashes, words=7):
    return [{"ord": k, "line": k, "words": words, "hash": h} for k, h in enumerate(hashes)]


def equal_runs(early, late, least):
    """Lines of every run of ``late`` that is somewhere in ``early`` and holds enough words, by trying all."""
    out = set()
    for i in range(len(late)):
        for j in range(len(early)):
            n = 0
            while i + n < len(late) and j + n < len(early) and late[i + n]["hash"] == early[j + n]["hash"]:
                n += 1
            if sum(x["words"] for x in late[i : i + n]) >= least:
                out.update(range(i, i + n))
    return sorted(out)


def test_blocks_that_no_alignment_shows_are_found():
    p = [1, 2, 3, 4]
    assert ld.common_blocks(items([*p, *p, 9]), items([9, *p, *p]), 20) == list(range(1, 9))
    assert ld.common_blocks(items([1, 2, 3, 8, 3, 4, 5]), items([1, 2, 3, 4, 5]), 20) == list(range(5))  # blocks that overlap
    rng = random.Random(7)
    for _ in range(500):
        early, late = (items([rng.randrange(6) for _ in range(rng.randrange(14))]) for _ in range(2))
        assert ld.common_blocks(early, late, 20) == equal_runs(early, late, 20)
