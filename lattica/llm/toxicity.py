"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of embeddings of its character trigrams, of its runs of five characters and of the word itself; only features
whose share differs clearly between the labels have an embedding, so that few labels don't teach the network
single documents by heart. Windows of 32 words that overlap by a quarter cover the whole text; a text scores as its most toxic window.
Training is multiple-instance: a document's label goes to the window that scores highest at the time, beside random windows of
documents without the label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER_AZ, in_arrow, per_process, release, slices, texts_of

WINDOW, STRIDE = 32, 24
BUCKETS, WIDTH, HIDDEN = 1 << 18, 16, 8
#: A feature is learned if this many documents hold it and the log odds of its label are this many standard deviations off.
LEAST_HELD, LEAST_ODDS = 3, 2.0


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): for each word the buckets of its character trigrams, of its runs of five characters and, last, of the word itself."""
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    end = np.cumsum(size)
    three = raw.copy()
    three[:-1] |= raw[1:] << np.uint64(8)
    three[:-2] |= raw[2:] << np.uint64(16)
    five = three.copy()
    five[:-3] |= raw[3:] << np.uint64(24)
    five[:-4] |= raw[4:] << np.uint64(32)
    place = np.arange(len(raw)) - np.repeat(end - size, size)
    left = np.repeat(size, size) - place  # characters from here to the word's end; runs beyond it don't count
    mixed = (three + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    powers = (mixed ^ (mixed >> np.uint64(29))) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    powers[left < 3] = 0
    whole = np.add.reduceat(powers, end - size) * np.uint64(0x94D049BB133111EB)
    longer = (five + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    longer = (longer ^ (longer >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    # a quarter of the buckets each for the two lengths, half for words
    bucket = np.empty((len(raw), 3), dtype=np.int64)
    bucket[:, 0] = (mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS // 4)
    bucket[:, 1] = BUCKETS // 4 + (longer >> np.uint64(40)).astype(np.int64) % (BUCKETS // 4)
    bucket[end - 1, 2] = BUCKETS // 2 + (whole >> np.uint64(40)).astype(np.int64) % (BUCKETS // 2)
    keep = np.stack([left >= 3, left >= 5, left == 1], axis=1)
    count = np.add.reduceat(keep.sum(axis=1), end - size)
    return bucket[keep], np.cumsum(count) - count


def features_in_blocks(words: list[bytes], block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """As ``features``, a block of words at a time, as its working arrays take some hundred bytes a character."""
    buckets, starts, n = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], 0
    for k in range(0, len(words), block):
        bucket, start = features(words[k : k + block])
        buckets.append(bucket.astype(np.int32))
        starts.append(start + n)
        n += len(bucket)
    return np.concatenate(buckets), np.concatenate(starts)


def windows(count: int) -> list[tuple[int, int]]:
    """(first word, end) of the overlapping windows over ``count`` words."""
    return [(k, min(count, k + WINDOW)) for k in range(0, max(1, count - (WINDOW - STRIDE)), STRIDE)] if count else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights, by name: embeddings e; per direction input w, bias b, recurrent u; attention a; output o and bias c.

    ``kept`` holds the buckets that have an embedding, in order; the last row of e, zero, stands for all others.
    """

    p: dict[str, np.ndarray] = field(default_factory=dict)
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @classmethod
    def fresh(cls, kept: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        p = {"e": draw(len(kept) + 1, WIDTH, s=0.1), "a": draw(2 * HIDDEN, s=0.5), "o": draw(2 * HIDDEN, s=0.5), "c": np.full(1, -1.0, np.float32)}
        p["e"][-1] = 0
        for d in "fb":
            p |= {f"w{d}": draw(WIDTH, 3 * HIDDEN, s=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": draw(HIDDEN, 3 * HIDDEN, s=0.3)}
        return cls(p, kept)

    def table(self) -> np.ndarray:
        """The row of e of every bucket."""
        out = np.full(BUCKETS, len(self.kept), dtype=np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def rows(self, words: list[bytes], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows of e, starts) of the words' features."""
        bucket, start = features(words)
        return (self.table() if table is None else table)[bucket], start

    def word_vectors(self, words: list[bytes], table: np.ndarray | None = None) -> np.ndarray:
        """The sum of each word's embeddings; only features that have one are fetched."""
        row, start = self.rows(words, table)
        out = np.zeros((len(words), WIDTH), dtype=np.float32)
        at = np.flatnonzero(row < len(self.kept))
        if len(at):
            owner = np.repeat(np.arange(len(words)), np.diff(np.append(start, len(row))))[at]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] = np.add.reduceat(self.p["e"][row[at]], first, axis=0)
        return out

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """Input part of both directions' gates."""
        return np.concatenate([vectors @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"], axis=1)

    def logits(self, gates: np.ndarray, index: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows: index (time, window) of words in ``gates``, size: words of each window."""
        steps, n = index.shape
        h = np.empty((steps, n, 2 * HIDDEN), dtype=np.float32)
        full = bool((size == steps).all())
        for d, at in enumerate("fb"):
            u, state = self.p[f"u{at}"], np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = gates[index[t], 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
                y = state @ u
                zr = x[:, : 2 * HIDDEN]
                zr += y[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new = y[:, 2 * HIDDEN :]
                new *= zr[:, HIDDEN:]
                new += x[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                step = state - new
                step *= zr[:, :HIDDEN]
                step += new
                state = step if full else np.where((t < size)[:, None], step, state)
                h[t, :, HIDDEN * d : HIDDEN * (d + 1)] = state
        s = h @ self.p["a"]
        if not full:
            s = np.where(np.arange(steps)[:, None] < size, s, np.float32(-1e9))
        s -= s.max(axis=0)
        np.exp(s, out=s)
        value = h @ self.p["o"]
        return (s * value).sum(axis=0) / s.sum(axis=0) + self.p["c"][0]

    def gradients(self, row: np.ndarray, start: np.ndarray, index: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over windows; row and start give the words' features."""
        p, (steps, n), k = self.p, index.shape, HIDDEN
        vectors = np.add.reduceat(p["e"][row], start, axis=0)
        mask = (np.arange(steps)[:, None] < size)[..., None].astype(np.float32)
        h, kept = np.zeros((steps, n, 2 * k), dtype=np.float32), {}
        for d in "fb":
            x, u, state = (vectors @ p[f"w{d}"] + p[f"b{d}"])[index], p[f"u{d}"], np.zeros((n, k), dtype=np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                y_ = state @ u
                zr = sigmoid(x[t, :, : 2 * k] + y_[:, : 2 * k])
                new = np.tanh(x[t, :, 2 * k :] + zr[:, k:] * y_[:, 2 * k :])
                kept[d, t] = state, zr, new, y_[:, 2 * k :]
                state = mask[t] * ((1 - zr[:, :k]) * new + zr[:, :k] * state) + (1 - mask[t]) * state
                h[t, :, :k] = state if d == "f" else h[t, :, :k]
                if d == "b":
                    h[t, :, k:] = state
        s = np.where(mask[..., 0] > 0, h @ p["a"], -1e9)
        al = np.exp(s - s.max(axis=0))
        al /= al.sum(axis=0)
        pooled = (al[..., None] * h).sum(axis=0)
        error = ((sigmoid(pooled @ p["o"] + p["c"][0]) - y) * weight / weight.sum()).astype(np.float32)
        g = {"c": np.array([error.sum()], np.float32), "o": error @ pooled}
        dp = error[:, None] * p["o"]
        da = (h * dp).sum(axis=2)
        ds = al * (da - (al * da).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", ds, h)
        dh = al[..., None] * dp + ds[..., None] * p["a"]
        dx_all = np.zeros_like(vectors)
        for d in "fb":
            u, carry, dgates = p[f"u{d}"], np.zeros((n, k), dtype=np.float32), np.zeros((steps, n, 3 * k), dtype=np.float32)
            du = np.zeros_like(u)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                state, zr, new, hn = kept[d, t]
                z, r = zr[:, :k], zr[:, k:]
                top = dh[t, :, :k] if d == "f" else dh[t, :, k:]
                dstate = top + carry
                live = dstate * mask[t]
                dz = live * (state - new) * z * (1 - z)
                dn = live * (1 - z) * (1 - new * new)
                dr = dn * hn * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                back = np.concatenate([dz, dr, dn * r], axis=1)
                du += state.T @ back
                carry = live * z + back @ u.T + dstate * (1 - mask[t])
            g[f"u{d}"], g[f"b{d}"] = du, dgates.sum(axis=(0, 1))
            per_word = np.zeros((len(vectors), 3 * k), dtype=np.float32)
            np.add.at(per_word, index.ravel(), dgates.reshape(-1, 3 * k))
            g[f"w{d}"] = vectors.T @ per_word
            dx_all += per_word @ p[f"w{d}"].T
        g["e"] = (row, np.repeat(dx_all, np.diff(np.append(start, len(row))), axis=0))
        return g


def lay_out(index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word numbers as (time, window) with zeros behind short ones, and their sizes."""
    size = np.array([len(x) for x in index])
    out = np.zeros((int(size.max()), len(index)), dtype=np.int64)
    for k, x in enumerate(index):
        out[: len(x), k] = x
    return out, size


def telling(bucket: np.ndarray, start: np.ndarray, index: list[list[np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """The buckets whose share of documents differs clearly between the labels, in order."""
    ends = np.append(start[1:], len(bucket))
    held = np.zeros((2, BUCKETS))  # documents of each label that hold a feature
    for y, wins in zip(labels, index, strict=True):
        held[y, np.unique(np.concatenate([bucket[start[w] : ends[w]] for w in np.unique(np.concatenate(wins))]))] += 1
    total = np.bincount(labels, minlength=2)
    odds = np.log((held[1] + 0.5) / (total[1] + 1)) - np.log((held[0] + 0.5) / (total[0] + 1))
    spread = np.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5))
    return np.flatnonzero((held.sum(axis=0) >= LEAST_HELD) & (np.abs(odds) > LEAST_ODDS * spread))


def train(docs: Iterable[tuple[int, list[list[bytes]]]], rounds: int = 12, seed: int = 7, rate: float = 0.01) -> Network:
    """Fit a network to (label, windows of words) of each document. Without both labels it scores everything as the only one, without a
    feature that tells them apart by their share.

    docs is read once: each document's words become numbers before the next one's are split, as the driver runs this.
    """
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    index, own = [], []
    for y, ws in docs:
        wins = [np.array([number.setdefault(w, len(number)) for w in win], dtype=np.int32) for win in ws if win]
        if wins:
            index.append(wins)
            own.append(y)
    labels = np.array(own, dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        net = Network.fresh(np.zeros(0, dtype=np.int64), seed)
        net.p["o"][:] = 0
        net.p["c"][:] = 4.0 if len(labels) and labels[0] else -4.0
        return net
    bucket, start = features_in_blocks(list(number))
    del number
    kept = telling(bucket, start, index, labels)
    net = Network.fresh(kept, seed)
    if not len(kept):  # all words look alike, so the length of a window is all that could be learned
        net.p["o"][:] = 0
        net.p["c"][:] = np.log(labels.mean() / (1 - labels.mean()))
        return net
    row = net.table()[bucket]
    del bucket
    # features without an embedding go, but for the word itself, so that no word is without any
    stays = row < len(kept)
    stays[np.append(start[1:], len(row)) - 1] = True
    count = np.add.reduceat(stays.astype(np.int64), start)
    row, start, ends = row[stays], np.cumsum(count) - count, np.cumsum(count)
    flat, owner = [w for ws in index for w in ws], np.repeat(np.arange(len(index)), [len(ws) for ws in index])
    first = np.concatenate([[0], np.cumsum([len(ws) for ws in index])])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    grid, sizes = lay_out(flat)
    del flat, index
    balance = {1: 0.5 * len(labels) / labels.sum(), 0: 0.5 * len(labels) / (len(labels) - labels.sum())}
    balance = {y: b**0.5 for y, b in balance.items()}  # half-way between the labels' shares and even ones
    for turn in range(rounds):
        chance = rng.integers(first[:-1], first[1:])
        if turn < 2:  # the network knows nothing yet
            chosen = np.concatenate([chance, rng.integers(first[:-1], first[1:])])
        else:
            gates = net.gates(np.add.reduceat(net.p["e"][row], start, axis=0))
            score = np.concatenate([net.logits(gates, grid[:, k : k + 4096], sizes[k : k + 4096]) for k in range(0, len(sizes), 4096)])
            chosen = np.concatenate([np.lexsort((score, owner))[first[1:] - 1], chance[labels == 0]])
        for _ in range(max(1, 1500 // max(1, len(chosen)))):  # few documents: more passes a round
            chosen = rng.permutation(chosen)
            for low in range(0, len(chosen), 64):
                at = chosen[low : low + 64]
                words, local = np.unique(grid[:, at], return_inverse=True)
                own = np.concatenate([row[start[w] : ends[w]] for w in words])
                y = labels[owner[at]]
                g = net.gradients(own, np.concatenate([[0], np.cumsum(ends[words] - start[words])[:-1]]), local.reshape(len(grid), -1), sizes[at], y, np.array([balance[int(b)] for b in y], np.float32))
                for name, grad in g.items():
                    if name == "e":  # rows touched only, and never the last
                        rows, where = np.unique(grad[0], return_inverse=True)
                        total = np.zeros((len(rows), WIDTH), np.float32)
                        np.add.at(total, where, grad[1])
                        total, rows = total[rows < len(kept)], rows[rows < len(kept)]
                        m[name][rows] = 0.9 * m[name][rows] + 0.1 * total
                        v[name][rows] = 0.99 * v[name][rows] + 0.01 * total**2
                        net.p[name][rows] -= rate * m[name][rows] / (np.sqrt(v[name][rows]) + 1e-6)
                    else:
                        m[name] = 0.9 * m[name] + 0.1 * grad
                        v[name] = 0.99 * v[name] + 0.01 * grad**2
                        net.p[name] -= rate * m[name] / (np.sqrt(v[name]) + 1e-6)
    return net


class Scorer:
    """Scores texts with a network; keeps the gates of words it has met."""

    def __init__(self, net: Network, most: int = 100_000):
        self.net, self.most, self.table = net, most, net.table()
        self.known: dict[bytes, int] = {}
        self.gates = np.zeros((1 << 14, 6 * HIDDEN), dtype=np.float32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > self.most:
                known.clear()
                new = list(set(words))
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            while len(known) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self.gates[first + k : first + k + len(part)] = self.net.gates(self.net.word_vectors(part, self.table))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text: of its highest window; of an empty window for a text without words."""
        own = [t.translate(LOWER_AZ).split() for t in texts]
        best = np.full(len(texts), -np.inf, dtype=np.float32)
        count = np.array([len(w) for w in own], dtype=np.int64)
        number = self._numbers([w for ws in own for w in ws])
        base = np.concatenate([[0], np.cumsum(count)])
        # whole windows together, the last and shorter one of each text apart
        full_n = np.maximum(0, (count - WINDOW) // STRIDE + 1)
        who = np.repeat(np.arange(len(texts)), full_n)
        begin = base[who] + STRIDE * (np.arange(len(who)) - np.repeat(np.cumsum(full_n) - full_n, full_n))
        rest = count - STRIDE * full_n
        tail = np.flatnonzero((rest > WINDOW - STRIDE) | ((full_n == 0) & (count > 0)))
        for low in range(0, len(who), 4096):
            at = begin[low : low + 4096]
            got = self.net.logits(self.gates, number[at[None, :] + np.arange(WINDOW)[:, None]], np.full(len(at), WINDOW))
            np.maximum.at(best, who[low : low + 4096], got)
        order = tail[np.argsort(rest[tail], kind="stable")]
        for low in range(0, len(order), 4096):
            at = order[low : low + 4096]
            size = rest[at]
            place = (base[at] + STRIDE * full_n[at])[None, :] + np.minimum(np.arange(int(size.max()))[:, None], size - 1)
            np.maximum.at(best, at, self.net.logits(self.gates, number[place], size))
        best[count == 0] = self.net.p["c"][0]
        return sigmoid(best.astype(np.float64))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = 2400, most_windows: int = 400) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Training documents: at most ``most`` labelled rows, by the hash of their id, with at most ``most_windows`` windows each, spread evenly.

    Windows are split into words as the documents are asked for. These bounds hold for training alone. A document with several labels counts as the greatest; null labels don't count.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).where("doc_id is not null")
    # as many of the rarer label as fit into half of the bound
    half = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 3 if y else most - most // 3) for y in (0, 1)]
    chosen = half[0].unionByName(half[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_id, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), texts_of(batch.column("text")), strict=True):
                words = text.translate(LOWER_AZ).split()
                spans = windows(len(words))
                spans = [spans[i * len(spans) // most_windows] for i in range(most_windows)] if len(spans) > most_windows else spans
                out[0].append(doc_id)
                out[1].append(y)
                out[2].append([b" ".join(words[a:b]) for a, b in spans])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.binary()))], ["doc_id", "y", "wins"])

    rows = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), run, "doc_id long, y int, wins array<binary>").collect()  # chosen: ``most`` rows at most
    rows.sort(key=lambda r: (r["doc_id"], len(r["wins"]), b"".join(r["wins"][:1])))
    return ((r["y"], [bytes(w).split() for w in r["wins"]]) for r in rows)


def score_texts(docs: DataFrame, net: Network, text: bool = False) -> DataFrame:
    """docs plus ``score``, 0 to 1, and, unless ``text`` is asked for, without text.

    Null and empty texts get the score of a text without words, a text of any length is scored whole. Rows are scored one by
    one: repeated rows score alike, an empty table gives an empty one. ``score`` in docs is replaced.
    """
    kept = [c for c in docs.columns if c != "score"]
    key = f"{hash(tuple(float(x.sum()) for x in net.p.values()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_process(("toxicity", key), lambda: Scorer(net))
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                score = pa.array(scorer.scores(texts_of(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in back), score], [*back, "score"])

    back = [c for c in kept if text or c != "text"]
    schema = docs.select(*back).schema.add("score", "double")
    return in_arrow(docs.select(*kept), run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 2400) -> Network:
    """A network trained on labels(doc_id, label) of docs(doc_id, text)."""
    net = train(sample(docs, labels, label, most=most))
    release()  # the driver goes on with other stages
    return net
