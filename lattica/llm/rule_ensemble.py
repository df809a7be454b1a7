"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are taken from whole texts in one pass. Boosted trees on a bounded labelled sample give paths; each path is a
conjunction of thresholds. A lasso-penalised logistic regression weighs the rules, most of them with zero, and
those left are compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import in_arrow, long_parts, slices, texts_of

STATS = (
    "n_words", "word_length", "longest_word", "symbols", "bangs", "bars", "digits", "upper", "commas", "stops", "other_punct", "non_ascii",
    "line_words", "stop_lines", "dup_lines", "dup_line_bytes", "distinct_words", "top_word", "dup_windows", "capital_words",
)
_BYTES = np.arange(256)
_IN = {name: np.isin(_BYTES, list(chars)) for name, chars in {"symbols": b"#*$%&<>@^~=", "bangs": b"!?", "bars": b"|", "digits": b"0123456789", "commas": b",;:", "stops": b".", "other_punct": b"()[]{}\"'/\\_-+`"}.items()}
_UPPER, _LOWER, _HIGH, _SPACE = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), _BYTES >= 128, np.isin(_BYTES, [9, 10, 11, 12, 13, 32])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and numbers of the different values."""
    _, at, times = np.unique(hashes, return_index=True, return_counts=True)
    return at, times


def statistics(text: bytes, part: int = 4 << 20) -> list[float]:
    """The values of STATS for one text; all zero for one without words. Words and lines are held as hashes, so memory stays a few times the text."""
    from xxhash import xxh64_intdigest

    hashes, lead, longest = [], [], 0
    for some in long_parts(text, part):
        if words := some.split():
            hashes.append(np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
            lead.append(np.fromiter((w[0] for w in words), dtype=np.uint8, count=len(words)))
            longest = max(longest, *map(len, words))
    if not hashes:
        return [0.0] * len(STATS)
    word, lead = np.concatenate(hashes), np.concatenate(lead)
    n = len(word)
    raw = np.frombuffer(text, dtype=np.uint8)
    count = sum(np.bincount(raw[k : k + (1 << 20)], minlength=256) for k in range(0, len(raw), 1 << 20))
    solid = int(count[~_SPACE].sum())
    lines = []
    for k, some in enumerate(long_parts(text, part, b"\n")):
        if own := [x for x in (some[1:] if k else some).split(b"\n") if x.strip()]:
            lines.append((np.fromiter(map(xxh64_intdigest, own), np.uint64, len(own)), np.fromiter(map(len, own), np.int64, len(own)), np.fromiter((x.rstrip()[-1] in b".!?" for x in own), bool, len(own))))
    line, width, stop = (np.concatenate(x) for x in zip(*lines, strict=True))
    seen, _ = _distinct(line)
    first, times = _distinct(word)
    three = (word[:-2] * np.uint64(0x9E3779B97F4A7C15) + word[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + word[2:] if n > 2 else word[:1]
    share = {name: count[mask].sum() / n for name, mask in _IN.items()}
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    return [
        float(n), solid / n, float(longest), share["symbols"], share["bangs"], share["bars"], count[_IN["digits"]].sum() / solid, upper / max(1, upper + lower),
        share["commas"], share["stops"], share["other_punct"], count[_HIGH].sum() / solid, n / len(line), stop.mean(),
        1 - len(seen) / len(line), 1 - width[seen].sum() / width.sum(), len(times) / n, times.max() / n, 1 - len(np.unique(three)) / max(1, n - 2), _UPPER[lead[first]].mean(),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """docs without ``text``, plus the statistics of the text as columns _stat_0, _stat_1, ...; such columns in ``docs`` are dropped Null text: as empty."""
    kept = [c for c in docs.columns if c != "text" and not c.startswith("_stat_")]
    schema = docs.select(*kept).schema
    for k in range(len(STATS)):
        schema = schema.add(f"_stat_{k}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values = np.array([statistics(t) for t in texts_of(batch.column("text"))], dtype=np.float64).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v) for v in values.T)], [*kept, *(f"_stat_{k}" for k in range(len(STATS)))])

    return in_arrow(docs.select(*kept, "text"), run, schema)


Condition = tuple[int, bool, float]  # statistic, above?, threshold


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths to every node of one second-order tree, and its step for each row."""
    paths: list[tuple[Condition, ...]] = []
    step = np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        if path:
            paths.append(path)
        best = (1e-6, -1, 0)
        if len(path) < depth and len(rows) >= 2 * least:
            for f, cut_ in enumerate(cuts):
                if not len(cut_):
                    continue
                b = bins[rows, f]
                size = np.cumsum(np.bincount(b, minlength=len(cut_) + 1))[:-1]
                gl, hl = np.cumsum(np.bincount(b, grad[rows], len(cut_) + 1))[:-1], np.cumsum(np.bincount(b, hess[rows], len(cut_) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(size < least) | (len(rows) - size < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            step[rows] = -g / (h + 1)
            return
        _, f, k = best
        high = bins[rows, f] > k
        grow(rows[~high], (*path, (f, False, float(cuts[f][k]))))
        grow(rows[high], (*path, (f, True, float(cuts[f][k]))))

    grow(np.arange(len(grad)), ())
    return paths, step


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, t in rule:
        out &= x[:, f] > t if above else x[:, f] <= t
    return out


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions; the score is the logistic function of their sum."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * holds(x, rule)
        return 1 / (1 + np.exp(-z))

    def column(self, stat: list[Column]) -> Column:
        """The score as an expression over the statistics' columns."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            fits = F.lit(True)
            for f, above, t in rule:
                fits = fits & ((stat[f] > t) if above else (stat[f] <= t))
            z = z + F.when(fits, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002) -> RuleModel:
    """Fit rules to statistics and labels. With one label only, the model is its bias."""
    if not len(y) or y.min() == y.max():
        return RuleModel(4.0 if len(y) and y[0] else (-4.0 if len(y) else 0.0), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, least = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), max(3, len(y) // 400)
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, step = _tree(bins, cuts, p - y, p * (1 - p), depth, least)
        z += 0.3 * step
        found |= dict.fromkeys(tuple(sorted(q)) for q in paths)
    rules = list(found)
    m = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float64)
    spread = np.maximum(m.std(axis=0), 0.02)
    m = m / spread
    rate = 4 / (np.linalg.norm(m.T @ m, 2) / len(y) + 1)
    w = v = np.zeros(len(rules))
    bias = vb = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(400):  # accelerated proximal steps
        error = 1 / (1 + np.exp(-(m @ v + vb))) - y
        nw = v - rate * (m.T @ error) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb, nt = vb - rate * error.mean(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return RuleModel(float(bias), tuple((r, float(a / s)) for r, a, s in zip(rules, w, spread, strict=True) if abs(a) > 1e-9))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8000) -> RuleModel:
    """Train on at most ``most`` labelled documents, chosen by the hash of their id. Of several labels the least counts; nulls don't."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("_y")).where("doc_id is not null")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # chosen: ``most`` rows at most
    rows = sorted(tuple(r) for r in measured(joined).collect())
    data = np.array(rows, dtype=np.float64).reshape(-1, 2 + len(STATS))
    return train(data[:, 2:], data[:, 1])


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs without text, plus ``score``.

    Null and empty texts score by zero statistics, a text of any length is measured whole. Rows are scored one by one: repeated
    rows score alike, an empty table gives an empty one. ``score`` in docs is replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "text") and not c.startswith("_stat_")]
    rows = measured(docs.select(*kept, "text"))
    return rows.select(*kept, model.column([F.col(f"_stat_{k}") for k in range(len(STATS))]).alias("score"))
