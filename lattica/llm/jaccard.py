"""Near-duplicates by the Jaccard similarity of word shingles: the SimHash operator's rings name candidates, exact sets decide.

A text is the set of its shingles (XXH64). Texts with equal sets are one node. A set's code is 20 SimHash fingerprints of 64 bits, each a ring of
five segments. Two sets meet in the bucket of every segment that they have equal; chains from it keep the budgets of the pigeonring
filter, 3 bits a segment, or the pair is dropped (lattica.llm.simhash.candidates). Sets of similarity 0.8 differ in about 9.7 of 64 bits, so they
share some 12 of their 100 buckets there; others differ in about 32. What candidates reach is a group. Within tiles of a group
the sizes and all 1,280 bits drop pairs and each comparison left intersects the whole sets; a tile gives back a forest and never the pairs. Nothing
that shares a bucket is left out, however full the bucket or large the group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER_AZ, cut, groups_in, in_arrow, slices, texts_of
from lattica.llm.components import joined
from lattica.llm.line_dedup import NO_ID
from lattica.llm.simhash import RING_BITS, RINGS, candidates, code

#: Bits of 64 in the first ring and of 1,280 in all that codes may differ in for their sets to be compared: at a similarity
#: of 0.8 they differ in 9.7, give or take 2.9, and in 194, give or take 13.
BITS, MOST = 26, RINGS * RING_BITS
#: Sets of a group that one task compares with as many others.
TILE = 512
SIZE = 5
#: Shingles of the least set that can be as similar to another one: four of five.
SMALLEST = 4
#: MinHash bands and sketches, by which the sets can be estimated; the near-duplicate stage takes neither. Minima that sketches must agree in.
BANDS, ROWS, LEAST = 25, 5, 82
#: One odd factor and one mask of each minimum. They work on half of a hash, which processors multiply several at a time.
_rng = np.random.default_rng(2)
BY = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MIX = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle, one without words has none.

    Words are hashed one by one and their hashes mixed in order, so a word is read once and not once for each shingle.
    """
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    word, size = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)), min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ word[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def minima(own: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    half, least = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max)
    for k in range(0, len(own), block):
        least = np.minimum(least, ((half[k : k + block] ^ MIX) * BY).min(axis=1))
    return least


def bands(own: np.ndarray, block: int = 1024) -> list[int]:
    """The buckets of a set of shingles, as signed longs; none for the empty set."""
    return buckets(minima(own, block)) if len(own) else []


def buckets(least: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(one.tobytes(), i) for i, one in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray) -> bytes:
    """One byte of each minimum: two sets agree in about as many as their similarity says."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def prints(docs: DataFrame) -> DataFrame:
    """(id, version, node, n, code) of every row of docs(id, version, text); ``node`` names the set, ``n`` is its size, ``code`` its SimHash rings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in slices(whole, "text"):
                node, n, codes = [], [], []
                for text in texts_of(batch.column("text")):
                    own = shingles(text)
                    node.append(xxh64_intdigest(own.tobytes()))
                    n.append(len(own))
                    codes.append(code(own).tobytes())
                columns = [batch.column("id"), batch.column("version"), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "node", "n", "code"])

    return in_arrow(docs.select("id", "version", "text"), run, "id long, version long, node long, n int, code binary")


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those pairs(u, v) whose sketches agree in LEAST bytes or more, by sketches(node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= LEAST))

    one, two = (sketches.select(F.col("node").alias(k), F.col("sketch").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    return in_arrow(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b"), run, "u long, v long")


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, own): the shingles of every row of docs(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                own = [shingles(t).view(np.int64) for t in texts_of(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    return in_arrow(docs.select("node", "text"), run, "node long, own array<long>")


def linked_within(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): edges that join similar sets of a group, by rows(group, node, n, code, parts) and texts(node, text); of each group a forest, never its pairs.

    A group is dealt into ``parts`` blocks that meet pair by pair, so none is one task's. Pairs that are joined already are not looked at; the
    others pass the sizes and all bits of their codes before their sets are intersected.
    """
    sets = sets_of(texts.dropDuplicates(["node"]))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = rows.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.least("part", "other").cast("long") * (1 << 31) + F.greatest("part", "other")
    dealt = dealt.select("group", tile.alias("tile"), "node", "n", "code", (F.col("part") > F.col("other")).alias("right")).join(sets, "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_in(batches, ["group", "tile"]):
            group, tiles, node, n, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "tile", "node", "n", "right"))
            column, codes = batch.column("own"), batch.column("code").to_pylist()
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (tiles[1:] != tiles[:-1])])).tolist()
            u: list[int] = []
            v: list[int] = []
            for low, high in zip(begin, [*begin[1:], len(node)], strict=True):
                bits = np.frombuffer(b"".join(codes[low:high]), dtype=np.uint64).reshape(high - low, -1)
                of, size, side = np.arange(high - low), n[low:high], right[low:high]
                within = int(tiles[low]) >> 31 == int(tiles[low]) & ((1 << 31) - 1)
                for i in range(high - low - 1):
                    j = np.flatnonzero(of[i + 1 :] != of[i]) + i + 1
                    if not within:
                        j = j[side[j] != side[i]]
                    j = j[5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i])]
                    j = j[np.bitwise_count(bits[j, 0] ^ bits[i, 0]) <= BITS]
                    j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= MOST] if len(j) else j
                    for k in j.tolist():
                        if of[k] != of[i]:
                            a, b = (flat[ends[low + x] : ends[low + x + 1]] for x in (i, k))
                            # i / (a + b - i) >= 4 / 5, in whole numbers
                            if 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)):
                                of[of == of[k]] = of[i]
                                u.append(int(node[low + i]))
                                v.append(int(node[low + k]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(dealt.repartition(parts, "group", "tile").sortWithinPartitions("group", "tile"), link, "u long, v long")


def representatives(docs: DataFrame) -> DataFrame:
    """(id, version) of the least row of each component of docs(id, version, text). NO_ID comes last."""
    late = (F.col("id") == NO_ID).alias("late")
    nodes = prints(docs).groupBy("node").agg(F.min(F.struct(late, "id", "version", "n", "code")).alias("least"))
    nodes = cut(nodes.select("node", "least.*"))
    groups = cut(joined(candidates(nodes.where(F.col("n") >= SMALLEST).select("node", "code"))).withColumnRenamed("root", "group"))
    parts = cut(groups.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))
    rows = cut(nodes.join(groups, "node").join(parts, "group"))
    texts = docs.join(rows.select("id", "version", "node"), ["id", "version"]).select("node", "text")
    linked = joined(linked_within(rows.select("group", "node", "n", "code", "parts"), texts)).withColumnRenamed("node", "of")
    named = nodes.join(linked, nodes["node"] == linked["of"], "left").groupBy(F.coalesce("root", "node").alias("root"))
    return named.agg(F.min(F.struct("late", "id", "version")).alias("least")).select("least.id", "least.version")
