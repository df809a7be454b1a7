"""Line deduplication by pairwise alignment.

Lines are hashed once. A window is a run of neighbouring lines that holds just enough words, counted forwards or backwards
from any line of a document; every line of a block with enough words lies in a window within it. A window that several documents share names
candidate pairs: its first holder with each later one, so a window held by n documents names n - 1 pairs, however
frequent its lines are, and whatever block a later document shares with any earlier one, each line of it is met again in a first
holder. Each pair is aligned by patience diff over the
lines that are shared at all; runs of aligned lines, consecutive in both documents, that hold enough words are
deleted from the later document. The first holder of a line never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, in_arrow, slices, texts_of, unused

Pairs = list[tuple[int, int]]
NO_ID = -(1 << 63)


def patience(a: list, b: list) -> Pairs:
    """Index pairs of equal lines in ascending order: common ends first, then lines unique in both, then between them."""
    out: Pairs = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if times_b[b[j]] == 1}
        unique = [(i, at[a[i]]) for i in range(a0, a1) if times_a[a[i]] == 1 and a[i] in at]
        if not unique:
            continue
        tails: list[int] = []  # least last j of a chain of each length
        ends: list[int] = []
        back = [-1] * len(unique)
        for k, (_, j) in enumerate(unique):
            p = bisect_left(tails, j)
            back[k] = ends[p - 1] if p else -1
            if p == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[p], ends[p] = j, k
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(unique[k])
            k = back[k]
        for i, j in reversed(chain):
            if i < a0 or j < b0:
                continue
            todo.append((a0, i, b0, j))
            out.append((i, j))
            a0, b0 = i + 1, j + 1
        todo.append((a0, a1, b0, b1))
    return sorted(out)


def common_blocks(early: list[dict], late: list[dict], least_words: int) -> list[int]:
    """Raw line numbers of ``late`` that lie in aligned blocks with at least ``least_words`` words.

    One alignment holds blocks in the order of both documents; blocks that moved are found by aligning what is left again, until
    an alignment deletes nothing. Lines that repeat can hide a block from every alignment, and a deleted block can cut another that
    overlaps it; so runs of ``late`` that are equal to a run of ``early`` are then matched by their windows.
    """
    both = {x["hash"] for x in early}.intersection(x["hash"] for x in late)
    if sum(x["words"] for x in late if x["hash"] in both) < least_words:
        return []
    early, late = [x for x in early if x["hash"] in both], [x for x in late if x["hash"] in both]
    out: set[int] = set()
    whole = late
    while late:
        gone: set[int] = set()
        run: list[int] = []
        words, last = 0, (-2, -2)
        for i, j in [*patience([x["hash"] for x in early], [x["hash"] for x in late]), (-9, -9)]:
            here = (early[i]["ord"], late[j]["ord"]) if i >= 0 else (-9, -9)
            if here != (last[0] + 1, last[1] + 1):
                if words >= least_words:
                    gone.update(run)
                run, words = [], 0
            if i >= 0:
                run.append(j)
                words += late[j]["words"]
            last = here
        if not gone:
            break
        out.update(late[j]["line"] for j in gone)
        late = [x for j, x in enumerate(late) if j not in gone]
    if late:
        held = {tuple(x["hash"] for x in early[i:j]) for i, j in windows(early, least_words)}
        for i, j in windows(whole, least_words):
            if tuple(x["hash"] for x in whole[i:j]) in held:
                out.update(x["line"] for x in whole[i:j])
    return sorted(out)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(id, version, line, ord, words, hash): every line with a word; ``ord`` counts such lines, ``line`` all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list] = [[], [], [], [], [], []]
                for key, version, text in zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), texts_of(batch.column("text")), strict=True):
                    ord_ = 0
                    for k, line in enumerate(text.split(b"\n")):
                        if line and (words := len(line.split())):
                            h = xxh64_intdigest(line.strip())
                            for o, x in zip(out, (key, version, k, ord_, words, h - (1 << 64) if h >> 63 else h), strict=True):
                                o.append(x)
                            ord_ += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["id", "version", "line", "ord", "words", "hash"])

    return in_arrow(docs, run, "id long, version long, line int, ord int, words int, hash long")


def windows(items: list[dict], least_words: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the windows in a document's shared lines: the shortest run from, and up to, each line that holds enough words."""
    for up in (True, False):
        low = high = words = 0  # items[low:high] are neighbours
        while high < len(items):
            if high > low and items[high]["ord"] != items[high - 1]["ord"] + 1:
                low, words = high, 0
            words += items[high]["words"]
            high += 1
            if up:
                while words >= least_words:  # the shortest run from low ends here
                    yield low, high
                    words -= items[low]["words"]
                    low += 1
            else:
                while words - items[low]["words"] >= least_words:
                    words -= items[low]["words"]
                    low += 1
                if words >= least_words:
                    yield low, high


def window_keys(listed: DataFrame, least_words: int) -> DataFrame:
    """(id, version, key): every window of listed(id, version, own) by the hash of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch, out = whole.slice(low, 256), ([], [], [])
                for key, version, own in zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), batch.column("own"), strict=True):
                    items = own.as_py()
                    hashes = pa.array([x["hash"] for x in items], pa.int64()).to_numpy()
                    for h in {xxh64_intdigest(hashes[i:j].tobytes()) for i, j in windows(items, least_words)}:
                        for o, x in zip(out, (key, version, h - (1 << 64) if h >> 63 else h), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "version", "key"])

    return in_arrow(listed, run, "id long, version long, key long")


def first_holders(rows: DataFrame, by: str) -> DataFrame:
    """(by, first) of those values of a column that several documents hold, apart from later joins, which can then split a very common one."""
    key = F.struct("id", "version")
    return cut(rows.groupBy(by).agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last").select(by, "first"))


def deletions(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """(id, version, gone): raw line numbers to delete from each document of docs(id, version, text) that loses any."""
    key = F.struct("id", "version")
    lines = cut(line_hashes(docs))
    shared = lines.join(first_holders(lines, "hash").select("hash"), "hash")
    item = F.struct("ord", "line", "words", "hash")
    listed = cut(shared.groupBy("id", "version").agg(F.array_sort(F.collect_set(item)).alias("own")))  # of one document; read twice
    held = cut(window_keys(listed, least_words))
    named = held.join(first_holders(held, "key"), "key").where(F.col("first") < key)
    pairs = named.select("id", "version", F.col("first.id").alias("f_id"), F.col("first.version").alias("f_version")).distinct()
    early = listed.select(F.col("id").alias("f_id"), F.col("version").alias("f_version"), F.col("own").alias("early"))
    both = pairs.join(listed, ["id", "version"]).join(early, ["f_id", "f_version"]).select("id", "version", "early", F.col("own").alias("late"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch, out = whole.slice(low, 256), ([], [], [])
                for k in range(batch.num_rows):
                    if gone := common_blocks(batch.column("early")[k].as_py(), batch.column("late")[k].as_py(), least_words):
                        for o, x in zip(out, (batch.column("id")[k].as_py(), batch.column("version")[k].as_py(), gone), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["id", "version", "gone"])

    found = in_arrow(both, align, "id long, version long, gone array<int>")
    return found.groupBy("id", "version").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """docs with ``text`` less its deleted lines, plus ``n_lines`` and ``n_deleted``.

    Later means a greater doc_id (null first), then the greater XXH64 of the text; rows equal in both are one
    document and share its result. Null and empty texts stay as they are, a text of any length is aligned whole, an empty table gives an empty
    one. Lines are compared without surrounding white space. Columns of the two names in ``docs`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    id_, version, gone_, lines_ = unused(docs.columns, "_id", "_version", "_gone", "_lines")
    keyed = docs.select(*kept, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(id_), F.xxhash64("text").alias(version))
    gone = cut(deletions(keyed.select(F.col(id_).alias("id"), F.col(version).alias("version"), "text"), least_words))
    gone = gone.select(F.col("id").alias(id_), F.col("version").alias(version), F.col("gone").alias(gone_)).hint("shuffle_hash")
    joined = keyed.join(gone, [id_, version], "left").withColumn(lines_, F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone_)), lambda k: F.col(lines_)[k])
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")
    n_lines = F.coalesce(F.size(lines_), F.lit(0)).alias("n_lines")
    return joined.select(*[text if c == "text" else c for c in kept], n_lines, F.coalesce(F.size(gone_), F.lit(0)).alias("n_deleted"))
