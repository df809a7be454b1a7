"""SimHash near-duplicates, found by pigeonring filtering.

The 64 bits form a ring of five segments. If two fingerprints differ in at most four bits, some segment starts
a chain whose first segment is equal, whose first two differ in at most one bit, first three in at
most two, first four in at most three (the proportional budgets 4k/5). So a fingerprint goes to the buckets named by
each segment and its successor, and by the successor with one zero bit set; two linked fingerprints meet
in one. Within a bucket, chains prune before the full Hamming check, and a search over the points not
yet reached gives a spanning forest, never all pairs. A bucket with more fingerprints than a bound is
split into blocks that meet pair by pair, so no bucket is one task's.

Sets that need not be that close have codes of RINGS fingerprints, each with hashes of its own. Every segment of each ring names a
bucket; chains from there prune, the next ring's bits after them, and what is left is a forest of candidates for an exact check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER_AZ, cut, groups_in, in_arrow, slices, texts_of
from lattica.llm.components import components, least_reached, stars

#: Widths and low bits of the ring's segments.
WIDTHS = (13, 13, 13, 13, 12)
LOWS = (0, 13, 26, 39, 52)
MASKS = tuple(((1 << w) - 1) << low for w, low in zip(WIDTHS, LOWS, strict=True))
BITS = 4

#: Fingerprints of a code, and the budget of bits of each.
RINGS, RING_BITS = 20, 15
#: Buckets of more fingerprints are searched one by one, smaller ones all at a time.
FEW = 64
_rng = np.random.default_rng(3)
MIX = _rng.integers(0, 1 << 63, (RINGS, 1), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (RINGS, 1), dtype=np.uint64)
BY = _rng.integers(0, 1 << 63, (RINGS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def majority(h: np.ndarray, block: int = 1 << 14) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), block):
        ones += np.unpackbits(h[k : k + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = 4) -> int:
    """The SimHash of a text's word shingles (XXH64 with seed 42); 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    low = np.concatenate([[0], ends[: n - 1]])
    high = ends[min(size, len(words)) - 1 :][:n] - 1
    cuts = map(slice, low.tolist(), high.tolist())
    return majority(np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), dtype=np.uint64, count=n))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row of docs(doc_id, text), as a signed long. Null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = np.array([fingerprint(t, size) for t in texts_of(batch.column("text"))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def buckets_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, fp, exact) of every bucket that each fingerprint goes to; exact: named by its own bits."""
    fp = fp.view(np.uint64)
    keys, who, exact = [], [], []
    for i in range(5):
        j = (i + 1) % 5
        own = (np.uint64(i) << np.uint64(26)) | (((fp >> np.uint64(LOWS[i])) & np.uint64((1 << WIDTHS[i]) - 1)) << np.uint64(13)) | ((fp >> np.uint64(LOWS[j])) & np.uint64((1 << WIDTHS[j]) - 1))
        keys.append(own)
        who.append(fp)
        exact.append(np.ones(len(fp), dtype=bool))
        for b in range(WIDTHS[j]):
            zero = (own >> np.uint64(b)) & np.uint64(1) == 0
            keys.append(own[zero] | np.uint64(1 << b))
            who.append(fp[zero])
            exact.append(np.zeros(int(zero.sum()), dtype=bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(who).view(np.int64), np.concatenate(exact)


def ring(x: Column, bits: int) -> Column:
    """Whether ``x``, the exclusive or of two fingerprints, has a start on the ring from which every chain of segments keeps its budget.

    True of all pairs that differ in ``bits`` or fewer, and, as the chain of all segments counts, of no others.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out = F.lit(False)
    for start in range(5):
        mask, holds = 0, F.lit(True)
        for k in range(1, 6):
            mask |= MASKS[(start + k - 1) % 5]
            holds &= F.bit_count(x.bitwiseAND(F.lit(signed(mask)))) <= bits * k // 5
        out |= holds
    return out


def near(one: np.uint64, others: np.ndarray, start: int, bits: int = BITS) -> np.ndarray:
    """Which of ``others`` differ from ``one`` in at most ``bits``: chains from ``start`` first, then all bits."""
    x = others ^ one
    at = np.arange(len(x))
    mask = MASKS[start]
    for k in range(2, 5):  # chains of two to four segments against their budgets
        mask |= MASKS[(start + k - 1) % 5]
        ok = np.bitwise_count(x & np.uint64(mask)) <= bits * k // 5
        x, at = x[ok], at[ok]
    return at[np.bitwise_count(x) <= bits]


def forest(fp: np.ndarray, start: int, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among ``fp`` whose chain starts at ``start``."""
    rest, u, v = np.unique(fp.view(np.uint64)), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            at = near(one, rest, start, bits)
            if len(at):
                found = rest[at]
                rest = np.delete(rest, at)
                queue += list(found)
                u += [one] * len(found)
                v += list(found)
    return u, v


def links(prints: DataFrame, block: int = 16_384) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of prints(fp) that keep every link's connection.

    A bucket with over ``block`` fingerprints is dealt out in blocks. The bound rises with the input so that at
    most 100,000 buckets can be so large, which bounds the broadcast table of them.
    """
    spark = prints.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for low in range(0, len(fp), 50_000):
                key, who, exact = buckets_of(np.ascontiguousarray(fp[low : low + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(exact)], ["bucket", "fp", "exact"])

    rows = in_arrow(prints.select("fp"), deal, "bucket long, fp long, exact boolean")
    n = prints.count()
    block = max(block, 5 * n // 100_000)
    large = cut(rows.where("exact").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block))
    tiles = rows.select("bucket", "fp", F.lit(0).alias("tile"))
    if large.limit(1).count():
        parts = F.ceil(F.col("n") / block).cast("int")
        own, other = F.pmod(F.xxhash64("fp"), F.coalesce(parts, F.lit(1))).cast("int"), F.col("other")
        tiles = rows.join(F.broadcast(large), "bucket", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
        tiles = tiles.select("bucket", "fp", (F.least("own", other) * 100_000 + F.greatest("own", other)).alias("tile"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_in(batches, ["bucket", "tile"]):
            key, tile, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "tile", "fp"))
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            u: list[int] = []
            v: list[int] = []
            pair = first[size == 2]  # most groups that aren't single are pairs
            x = fp[pair].view(np.uint64) ^ fp[pair + 1].view(np.uint64) if len(pair) else np.zeros(0, np.uint64)
            pair = pair[(np.bitwise_count(x) <= BITS) & (x != 0)]
            u += list(fp[pair].view(np.uint64))
            v += list(fp[pair + 1].view(np.uint64))
            for low, count in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                a, b = forest(np.ascontiguousarray(fp[low : low + count]), int(key[low]) >> 26)
                u += a
                v += b
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    return in_arrow(tiles.repartition(int(parts), "bucket", "tile").sortWithinPartitions("bucket", "tile"), link, "u long, v long")


def code(own: np.ndarray, block: int = 255 * 16) -> np.ndarray:
    """RINGS fingerprints of a set of hashes: each the bits that are set in over half of the hashes as mixed for it."""
    ones = np.zeros((RINGS, 8, 8), dtype=np.int64)  # by the bit of a byte, then the byte
    for k in range(0, len(own), block):
        x = (own[k : k + block] ^ MIX) * BY
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        starts = np.arange(0, x.shape[1], 255)  # as many as a byte can count
        for b in range(8):
            count = np.add.reduceat((x >> np.uint64(b)) & np.uint64(0x0101010101010101), starts, axis=1)
            ones[:, b] += count.view(np.uint8).reshape(RINGS, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits((2 * ones > len(own)).transpose(0, 2, 1).reshape(RINGS, 64), axis=1, bitorder="little").view("<u8")[:, 0]


def chained(fp: np.ndarray, follow: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (a, b) keep the budgets of every chain from segment ``start`` of their ring and of the ring after it."""
    x = fp[a] ^ fp[b]
    bits = np.bitwise_count(x)
    at = np.flatnonzero(bits <= RING_BITS)
    at = at[bits[at] + np.bitwise_count(follow[a[at]] ^ follow[b[at]]) <= 2 * RING_BITS]
    return np.concatenate([own[near(np.uint64(0), x[own], s, RING_BITS)] for s in range(5) if len(own := at[start[at] == s])] or [at[:0]])


def spanning(fp: np.ndarray, follow: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """Stars (least row, other) that reach what the pairs by ``chained`` do, by a search over the rows not yet reached."""
    rest, u, v = np.arange(len(fp)), [], []
    while len(rest) > 1:
        least, rest = int(rest[0]), rest[1:]
        queue = [least]
        while queue and len(rest):
            one = queue.pop()
            at = near(fp[one], fp[rest], start, RING_BITS)
            at = at[np.bitwise_count(fp[rest[at]] ^ fp[one]) + np.bitwise_count(follow[rest[at]] ^ follow[one]) <= 2 * RING_BITS]
            if len(at):
                found = rest[at].tolist()
                rest = np.delete(rest, at)
                queue += found
                u += [least] * len(found)
                v += found
    return u, v


def candidates(codes: DataFrame, block: int = 16_384) -> DataFrame:
    """(u, v): of each bucket stars around its least nodes that reach what the pairs of codes(node, code) do that meet in it and keep its chains.

    A bucket that may hold over ``block`` nodes is dealt out in blocks that meet pair by pair; the bound rises with the table, so
    that only buckets far above the average are.
    """
    spark = codes.sparkSession
    block = max(block, codes.count() // 512)
    tasks = max(1, codes.rdd.getNumPartitions())

    def keys(fp: np.ndarray, k: int, s: int) -> np.ndarray:
        return ((fp[:, k] >> np.uint64(LOWS[s])) & np.uint64((1 << WIDTHS[s]) - 1)).astype(np.int32) + np.int32((5 * k + s) << 13)

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype="<u8").reshape(batch.num_rows, RINGS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bucket of over ``block`` nodes has its share of that in some task
        n = np.zeros(5 * RINGS << 13, dtype=np.int64)
        for batch in batches:
            fp = read(batch)
            for k in range(RINGS):
                for s in range(5):
                    np.add.at(n, keys(fp, k, s), 1)
        at = np.flatnonzero(n > block // tasks)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                fp, node = read(batch), batch.column("node").to_numpy()
                bucket = np.concatenate([keys(fp, k, s) for k in range(RINGS) for s in range(5)])
                own, follow = (np.repeat(np.roll(fp, -d, axis=1).T, 5, axis=0).ravel().view(np.int64) for d in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, np.tile(node, 5 * RINGS), own, follow)], ["bucket", "node", "fp", "follow"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_in(batches, ["bucket", "tile"]):
            key, tile, node, fp, follow = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "tile", "node", "fp", "follow"))
            fp, follow, start = fp.view(np.uint64), follow.view(np.uint64), (key >> 13) % 5
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            left = np.repeat(first + size, size) - np.arange(len(key))  # rows of the bucket from here on
            left[np.repeat(size > FEW, size)] = 0
            one = np.flatnonzero(left > 1)
            a_, b_ = [one[:0]], [one[:0]]
            for d in range(1, FEW):
                one = one[left[one] > d]
                if not len(one):
                    break
                at = one[chained(fp, follow, one, one + d, start[one])]
                a_.append(at)
                b_.append(at + d)
            root = least_reached(len(node), np.concatenate(a_), np.concatenate(b_))
            at = np.flatnonzero(root < np.arange(len(node)))
            u, v = [node[root[at]]], [node[at]]
            for low, many in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                a, b = spanning(fp[low : low + many], follow[low : low + many], int(start[low]))
                u.append(node[low : low + many][a])
                v.append(node[low : low + many][b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(np.concatenate(u), np.concatenate(v))], ["u", "v"])

    rows = in_arrow(codes.select("node", "code"), deal, "bucket int, node long, fp long, follow long")
    large = in_arrow(codes.select("code"), count, "bucket int, n long").groupBy("bucket").agg((F.floor(F.sum("n") / block) + 2).cast("int").alias("parts"))
    large = cut(large)
    tiles = rows.withColumn("tile", F.lit(0).cast("long"))
    if large.limit(1).count():
        parts, other = F.coalesce("parts", F.lit(1)), F.col("other")
        own = F.pmod(F.xxhash64("fp", "follow"), parts).cast("int")
        tiles = rows.join(F.broadcast(large), "bucket", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        tiles = tiles.select("bucket", "node", "fp", "follow", (F.least("own", other).cast("long") * (1 << 31) + F.greatest("own", other)).alias("tile"))
    count_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(tiles.repartition(count_, "bucket", "tile").sortWithinPartitions("bucket", "tile", "node"), link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Fingerprints at 4 or fewer differing bits are linked; component_id is the least doc_id reachable. Texts without
    words share fingerprint zero. Repeated rows repeat in the result, an empty table gives an empty one, a text of any
    length is read whole. A null doc_id is never the least one unless its component has no other.
    """
    prints = cut(fingerprints(docs, size))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct.select("fp")))
    roots = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", "root")
    # fingerprints without a link name themselves; the others' names are met by a join that can split a large component
    grouped = cut(roots.where("root is not null"))
    names = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = grouped.join(names, "root").select("fp", "component_id").union(roots.where("root is null").select("fp", F.col("least").alias("component_id")))
    return prints.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
