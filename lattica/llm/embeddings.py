"""Near-duplicate embeddings by int8 tile products with rigorous quantisation bounds.

A unit vector x is kept as s * q, with q in int8 and s = max|x| / 127, and its residual in the same way, each with the exact norm
of what is left over. For any two vectors |x.y - x'.y'| <= |x'| e(y) + |y'| e(x) + e(x) e(y). Only these codes go to the tiles. A
tile multiplies the first codes, in whole numbers that single precision holds exactly; pairs that could reach the threshold are multiplied again
with the second codes, whose bound is some hundred times closer and decides nearly all of them. The few pairs that stay open, those
within about 1e-4 of the threshold, are computed in double precision from the full vectors. Equal vectors
are one with a multiplicity first. A tile gives back the number of links of each vector and a
spanning forest of its links, so what leaves it is linear in its rows, but for open pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import cut, groups_in, in_arrow
from lattica.llm.components import components

#: Dimensions whose products of int8 codes sum to less than 2 ** 24, which single precision holds exactly.
EXACT = (1 << 24) // 127**2
#: Covers the rounding of scales, norms and double-precision sums.
SLACK = 1e-6


@dataclass
class Codes:
    """Two int8 codes of each of several unit vectors, their scales, and the norms of both approximations and of what each leaves over."""

    q: np.ndarray  # (2, rows, dimensions)
    s: np.ndarray  # (2, rows)
    n: np.ndarray
    e: np.ndarray

    def take(self, at: np.ndarray | slice) -> Codes:
        return Codes(self.q[:, at], self.s[:, at], self.n[:, at], self.e[:, at])


def quantise(x: np.ndarray) -> Codes:
    """Codes of the rows of x, which are unit vectors in double precision."""
    left, whole, out = x, np.zeros_like(x), []
    for _ in range(2):
        scale = np.abs(left).max(axis=1, initial=0) / 127
        q = np.rint(left / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
        whole = whole + q * scale[:, None]
        left = x - whole
        out.append((q, scale, np.linalg.norm(whole, axis=1), np.linalg.norm(left, axis=1)))
    return Codes(*(np.stack(c) for c in zip(*out, strict=True)))


def linked_pairs(a: Codes, b: Codes, threshold: float, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, sure) of the pairs whose cosine may be at least ``threshold``, tile by tile; sure: it is, whatever was left over."""
    d = a.q.shape[2]
    spans = [slice(k, k + EXACT) for k in range(0, d, EXACT)]
    right = [([b.q[0, k : k + block, span].astype(np.float32).T.copy() for span in spans], k) for k in range(0, b.q.shape[1], block)]
    for low in range(0, a.q.shape[1], block):
        left = a.take(slice(low, low + block))
        codes = [left.q[0, :, span].astype(np.float32) for span in spans]
        for parts, k in right:
            e, n, s = (x[0, k : k + block] for x in (b.e, b.n, b.s))
            product = codes[0] @ parts[0]
            for x, y in zip(codes[1:], parts[1:], strict=True):
                product = product + (x @ y).astype(np.float64)
            product *= left.s[0][:, None].astype(product.dtype)
            product *= s.astype(product.dtype)
            widest = left.n[0].max() * e.max() + n.max() * left.e[0].max() + left.e[0].max() * e.max()
            i, j = np.nonzero(product >= product.dtype.type(threshold - widest - SLACK))
            close = product[i, j] + left.n[0][i] * e[j] + n[j] * left.e[0][i] + left.e[0][i] * e[j] >= threshold - SLACK
            i, j = i[close] + low, j[close] + k
            for m in range(0, len(i), 100_000):
                x, y = i[m : m + 100_000], j[m : m + 100_000]
                u, v = a.take(x), b.take(y)
                cosine = np.einsum("ij,ij->i", (u.q * u.s[..., None]).sum(axis=0), (v.q * v.s[..., None]).sum(axis=0))
                off = u.n[1] * v.e[1] + v.n[1] * u.e[1] + u.e[1] * v.e[1] + SLACK * 1e-4
                could = cosine + off >= threshold
                if could.any():
                    yield x[could], y[could], (cosine - off)[could] >= threshold


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of n nodes with edges (i, j)."""
    u, v = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    start = np.searchsorted(u, np.arange(n + 1))
    fresh = np.ones(n, dtype=bool)
    out: list[tuple[int, np.ndarray]] = []
    for root in np.unique(u).tolist():
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            x = queue.pop()
            found = v[start[x] : start[x + 1]]
            found = np.unique(found[fresh[found]])
            if len(found):
                fresh[found] = False
                out.append((x, found))
                queue += found.tolist()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([np.full(len(f), x) for x, f in out]), np.concatenate([f for _, f in out])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = 16_384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Rows link where their cosine in double precision is at least ``threshold``; vectors that are null, zero, empty or hold
    null or non-finite components, vectors of different lengths, and rows without a vec_id, link with nothing. A repeated row counts as another vector.
    component_id is the least vec_id reachable, ``kept`` marks that row. An empty table gives an empty one. ``block`` bounds the
    distinct vectors of a tile's side; each vector's codes are dealt out once for each block.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = np.dtype(np.float32 if isinstance(kind, T.FloatType) else np.float64)
    element = "float" if dtype.itemsize == 4 else "double"
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat, ends = column.flatten(), np.diff(np.asarray(column.offsets))
            there, named = np.asarray(column.is_valid()), np.asarray(batch.column("vec_id").is_valid())
            starts = np.concatenate([[0], np.cumsum(np.where(there, ends, 0))])
            values = flat.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)  # null: NaN; -0.0: 0.0
            raw = []
            for k in range(batch.num_rows):
                x = values[starts[k] : starts[k + 1]]
                good = there[k] and named[k] and len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x.astype(np.float64)) < np.inf
                raw.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    rows = cut(in_arrow(clean, pack, "vec_id long, raw binary"))
    distinct = cut(rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = distinct.count()
    # enough tiles for every core, but no more copies of the codes than those or the size of a tile ask for
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-n // block), min(-(-n // 2048), int((4 * cores) ** 0.5)), 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, numbers = batch.column("raw").to_pylist(), np.zeros((batch.num_rows, 6))
            size, codes = np.array([len(r) for r in raw]), [b""] * batch.num_rows
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                x = np.frombuffer(b"".join(raw[k] for k in at), dtype=dtype).reshape(len(at), -1).astype(np.float64)
                own = quantise(x / np.linalg.norm(x, axis=1)[:, None])
                numbers[at] = np.concatenate([own.s, own.n, own.e]).T
                for k, c in zip(at.tolist(), own.q.transpose(1, 0, 2), strict=True):
                    codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("own"), pa.array(codes, pa.binary()), pa.array([x.tobytes() for x in numbers], pa.binary())], ["rep", "copies", "own", "codes", "numbers"])

    own, other = F.pmod(F.xxhash64("raw"), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    coded = in_arrow(distinct.select("rep", "copies", own, "raw"), encode, "rep long, copies long, own int, codes binary, numbers binary")
    dealt = coded.select("*", other).withColumn("tile", F.least("own", "other").cast("long") * blocks + F.greatest("own", "other")).select("rep", "copies", "codes", "numbers", "tile", (F.col("own") > F.col("other")).alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in(batches, ["tile"]):
            tile = group.column("tile").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])).tolist()
            for low, high in zip(first, [*first[1:], len(tile)], strict=True):
                part = group.slice(low, high - low)
                rep, copies = part.column("rep").to_numpy(), part.column("copies").to_numpy()
                right, codes = part.column("right").to_numpy(zero_copy_only=False), part.column("codes").to_pylist()
                numbers = np.frombuffer(b"".join(part.column("numbers").to_pylist()), dtype=np.float64).reshape(-1, 3, 2)
                same = int(tile[low]) // blocks == int(tile[low]) % blocks
                size = np.array([len(x) for x in codes])
                links, pairs, unsure = np.zeros(len(rep), dtype=np.int64), [], []
                for width in np.unique(size).tolist():
                    at = np.flatnonzero(size == width)
                    q = np.frombuffer(b"".join(codes[k] for k in at), dtype=np.int8).reshape(len(at), 2, -1).transpose(1, 0, 2)
                    whole = Codes(q, *numbers[at].transpose(1, 2, 0))
                    a, b = (np.arange(len(at)),) * 2 if same else (np.flatnonzero(~right[at]), np.flatnonzero(right[at]))
                    if not len(a) or not len(b):
                        continue
                    for i, j, sure in linked_pairs(whole.take(a), whole.take(b), threshold):
                        i, j = at[a[i]], at[b[j]]
                        if same:
                            i, j, sure = i[i < j], j[i < j], sure[i < j]
                        unsure.append((i[~sure], j[~sure]))
                        i, j = i[sure], j[sure]
                        links += np.bincount(i, weights=copies[j], minlength=len(rep)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(rep)).astype(np.int64)
                        pairs.append((i, j))
                some = np.flatnonzero(links)
                u, v = spanning(len(rep), *(np.concatenate(x) for x in zip(*pairs, strict=True))) if pairs else (some[:0], some[:0])
                x, y = (np.concatenate(z) for z in zip(*unsure, strict=True)) if unsure else (some[:0], some[:0])
                # links of a vector have no v, edges of the forest no n, open pairs both
                columns = [pa.array(np.concatenate([rep[some], rep[u], rep[x]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(np.concatenate([rep[v], rep[y]]))])]
                yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.array(links[some]), pa.nulls(len(u), pa.int64()), pa.array(np.zeros(len(x), np.int64))])], ["u", "v", "n"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(r, dtype=dtype).astype(np.float64) for r in batch.column(c).to_pylist()] for c in ("x", "y"))
            near = np.array([a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold for a, b in zip(x, y, strict=True)], dtype=bool)
            yield batch.select(["u", "v", "cu", "cv"]).filter(pa.array(near))

    tiles = blocks * (blocks + 1) // 2
    parts = max(1, min(tiles, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = cut(in_arrow(dealt.repartition(parts, "tile").sortWithinPartitions("tile"), compare, "u long, v long, n long"))
    ends = [distinct.select(F.col("rep").alias(k), F.col("copies").alias(f"c{k}"), F.col("raw").alias(r)) for k, r in (("u", "x"), ("v", "y"))]
    open_ = found.where("v is not null and n is not null").select("u", "v").join(ends[0], "u").join(ends[1], "v")
    late = cut(in_arrow(open_.select("u", "v", "cu", "cv", "x", "y"), settle, "u long, v long, cu long, cv long"))
    each = found.where("v is null").select("u", "n").union(late.select("u", "cv")).union(late.select("v", "cu"))
    links = each.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("v is not null and n is null").select("u", "v").union(late.select("u", "v"))).withColumnRenamed("node", "rep")
    named = distinct.join(links, "rep", "left").join(roots, "rep", "left")
    named = named.select("raw", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    whole = rows.join(named, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
