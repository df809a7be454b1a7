"""Personal data and secrets in texts: base patterns and a skip-chain conditional random field.

Four patterns find the base spans. The field then labels the tokens that could be part of personal data or be a secret (those with
a digit or an at sign, and long ones of capitals) of each document: unary potentials from a token's shape and what stands before it,
chain potentials between tokens next to each other, and skip potentials between distant tokens that repeat or resemble one another, so
that a token whose shape alone says little takes the label of its likes. Loopy message passing over all of a document's tokens gives
marginals; confident tokens that no base span covers become spans. Where two kinds stand side by side a pattern runs
over both and fails; the field still tells them apart. Distant labels come from the base spans and from assignments to names like
``password``; tokens under a pattern that ran too far have no label, and training hides decisive features at times.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import in_arrow, slices

#: Kinds in the order of the contract; label 0 is "none of them".
KINDS = ("email", "ip", "card", "phone")
#: Patterns (fixed values of the query's contract).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and non-overlapping per kind, by start and then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # an address is the run of local characters before an at sign, and the domain behind it
        low = at
        while low > done and text[low - 1] in LOCAL:
            low -= 1
        if low < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((low, done, 0))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if any(map(text.__contains__, "0123456789")):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# --- tokens and features ---

SECRET = len(KINDS)
N_LABELS = 2 + len(KINDS)  # none, the kinds, secret
#: What ends a token, what is cut off its ends, and long runs of capitals, which need no digit.
BREAK = re.compile(r"[\x20\x09-\x0D\"'=<>|]")
HINT = re.compile(r"[0-9@]")
CAPITALS = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])")
TRIM = "`.,;:!?()[]{}#$%&*"
#: Names that secrets are assigned to, and beginnings of well-known keys (fixed values).
NAMED = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|credential|auth|bearer|key)s?[\"']?\s*(=>|[=:])?\s*[\"']?$")
ASSIGNED = re.compile(r"[=:]>?\s*[\"']?$")
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "xoxb-", "xoxp-", "eyJ")
HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
KEY = re.compile(r"[A-Za-z0-9+/_.~-]{12,}")


@dataclass
class Tokens:
    """The candidate tokens of a text: spans, features, edges, and which look like assigned secrets."""

    span: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    secret: np.ndarray


def shape(token: str, before: str = "") -> list[bool]:
    """The features of a token and of the text just ``before`` it; each is true or false."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    n, at, dots = len(token), token.count("@"), token.count(".")
    bare = token.replace("-", "")
    ascii_digits = bare.isascii() and bare.isdigit()
    octets = dots == 3 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in token.split("."))
    named = NAMED.search(before)
    turns = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(token[:64], token[1:64], strict=False))
    return [
        True, at == 1, at > 1, dots == 0, dots == 3, 0 < dots < 3, dots > 3, token[:1] == "+", "(" in token or ")" in token, "-" in token, digits == n, letters > 0 and digits > 0,
        digits <= 2, 2 < digits <= 4, 4 < digits <= 9, 9 < digits <= 13, 13 < digits <= 19, digits > 19, letters == 0, n > 24, n < 12, letters > 3 * digits,
        ascii_digits and 14 <= len(bare) <= 19 and luhn(bare), octets, bool(HEX.fullmatch(token)), bool(CAPITALS.fullmatch(token)), token.startswith(PREFIXES), bool(named), bool(named and named[1]),
        bool(ASSIGNED.search(before)), turns > 4, bool(KEY.fullmatch(token)), token.isascii(), letters > 0 and token.upper() == token,
    ]


N_FEATURES = len(shape("x"))
#: Groups of features that give a label away; training hides one group at a time.
DECISIVE = ((1, 3, 4, 5, 7, 8, 9), (27, 28, 29), (24, 25, 26, 30))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens with a digit or an at sign and of long runs of capitals, in time linear in the text."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := HINT.search(text, at):
        low = m.start()
        while low > at and not BREAK.match(text, low - 1):
            low -= 1
        end = BREAK.search(text, m.end())
        at = end.start() if end else len(text)
        out.append((low, at))
    held = set(out)
    out += [s for m in CAPITALS.finditer(text) if not any(map(m[0].__contains__, "0123456789")) and (s := m.span()) not in held]
    return sorted(out)


def tokens_of(text: str) -> Tokens:
    """Candidates of a text with their features, chain edges (neighbours within three characters) and skip edges."""
    spans, rows, chain, skip, secret = [], [], [], [], []
    seen: dict[str, int] = {}
    for low, high in candidates(text):
        before = text[max(0, low - 24) : low]
        while low < high and text[low] in TRIM and text[low] != "(":
            low += 1
        while low < high and text[high - 1] in TRIM and text[high - 1] != ")":
            high -= 1
        if low == high:
            continue
        token, k = text[low:high], len(spans)
        if spans and low - spans[-1][1] <= 3:
            chain.append((k - 1, k))
        spans.append((low, high))
        own = shape(token, before)
        rows.append(own)
        secret.append(bool(KEY.fullmatch(token)) and (token.startswith(PREFIXES) and len(token) >= 16 or own[28] and own[11]))
        digits = "".join(c for c in token if c in "0123456789")
        # alike: the same token whatever its case, the same digits, the same last seven digits, the same domain, the same run of key characters
        alike = {token.lower(), f"d{digits}" if len(digits) >= 6 else "", f"t{digits[-7:]}" if len(digits) >= 7 else "", f"@{token.lower().partition('@')[2]}" if "@" in token else "", f"k{token.lower()[:12]}" if own[31] and own[11] else ""}
        for key in alike - {""}:
            if key in seen and seen[key] != k:  # to the latest of its kind: a path, not all pairs
                skip.append((seen[key], k))
            seen[key] = k
    return Tokens(
        np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES), np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(sorted(set(skip)), dtype=np.int64).reshape(-1, 2),
        np.array(secret, dtype=bool),
    )


def met(tokens: Tokens, spans: list[Span]) -> np.ndarray:
    """The kind (plus one) of the first span that each token meets, else 0. Tokens are in order and apart; so are spans of a kind."""
    out = np.zeros(len(tokens.span), dtype=np.int64)
    for kind in sorted({k for _, _, k in spans}, reverse=True):
        own = np.array([(a, b) for a, b, k in spans if k == kind], dtype=np.int64)
        at = np.searchsorted(own[:, 1], tokens.span[:, 0], side="right")  # the first span that ends behind the token's start
        hit = at < len(own)
        hit[hit] = own[at[hit], 0] < tokens.span[hit, 1]
        out[hit] = kind + 1
    return out


def distant_labels(tokens: Tokens, text: str, spans: list[Span]) -> np.ndarray:
    """The label of each token by the base spans and by assignments; -1 for tokens under a pattern that ran over too many digits."""
    out = met(tokens, spans)
    out[(out == 0) & tokens.secret] = SECRET + 1
    far = [(m.start(), m.end(), 0) for p, most in ((PHONE, 15), (CARD, 19)) for m in p.finditer(text) if sum(c.isdigit() for c in m[0]) > most]
    out[(out == 0) & (met(tokens, _flat(far)) > 0)] = -1
    return out


def _flat(spans: list[Span]) -> list[Span]:
    """The union of spans, as spans in order and apart."""
    out: list[Span] = []
    for low, high, kind in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high), kind)
        else:
            out.append((low, high, kind))
    return out


@dataclass
class Field:
    """Unary weights (feature, label), chain and skip potentials (label, label), all log-linear."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(x: np.ndarray, y: np.ndarray, times: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 400) -> Field:
    """Piecewise: softmax regression for the unary part, smoothed log odds of label pairs for the two edge parts.

    Row k of x and y stands ``times[k]`` times; chain and skip count the label pairs of edges.
    """
    w = np.zeros((N_FEATURES, N_LABELS))
    if len(x):
        hidden = []
        for group in DECISIVE:
            part = x.copy()
            part[:, group] = 0
            hidden.append(part)
        both = np.concatenate([x, *hidden])
        share = np.concatenate([times, *[0.1 * times] * len(hidden)]).astype(np.float64)
        target = np.eye(N_LABELS)[np.tile(y, 1 + len(hidden))]
        size = share @ target
        share *= np.minimum(10.0, np.sqrt(size.max() / np.maximum(size, 1)))[np.tile(y, 1 + len(hidden))]  # rare labels count for more
        share /= share.sum()
        step, fast = 2.0 / max(1.0, float((share[:, None] * both**2).sum())), w
        for k in range(rounds):  # accelerated gradient steps
            z = both @ fast
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = fast - step * (both.T @ (share[:, None] * (p - target)) + 1e-5 * fast)
            fast, w = new + k / (k + 3) * (new - w), new

    def pairs(seen: np.ndarray) -> np.ndarray:
        n = seen + seen.T + 0.5 + 2 * np.eye(N_LABELS)
        n /= n.sum()
        return np.clip(np.log(n) - np.log(n.sum(axis=1, keepdims=True)) - np.log(n.sum(axis=0, keepdims=True)), -1, 3)

    return Field(w, pairs(chain), pairs(skip))


def marginals(field: Field, t: Tokens, rounds: int = 12, damp: float = 0.3) -> np.ndarray:
    """Label marginals of a document's tokens by loopy sum-product message passing, all edges at once."""
    unary = t.x @ field.unary
    unary -= unary.max(axis=1, keepdims=True)
    edges = np.concatenate([t.chain, t.skip])
    if not len(edges):
        p = np.exp(unary)
        return p / p.sum(axis=1, keepdims=True)
    potential = np.exp(np.concatenate([np.repeat(field.chain[None], len(t.chain), 0), np.repeat(field.skip[None], len(t.skip), 0)]))
    u, v = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(u), N_LABELS))  # logs
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, v, message)
        out = belief[u] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ea,eab->eb", out, potential) + 1e-12)
        new -= new.max(axis=1, keepdims=True)
        message = damp * message + (1 - damp) * new
    belief = unary.copy()
    np.add.at(belief, v, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


#: Digits that a run of tokens labelled as a card or a phone has at least and at most.
PLAUSIBLE = {2: (12, 19), 3: (7, 15)}


def all_spans(text: str, field: Field, least: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field adds confident tokens, and runs of chained ones for cards and phones, that touch no base span."""
    base = base_spans(text)
    if not any(map(text.__contains__, "0123456789@")) and not CAPITALS.search(text):
        return base, base
    t = tokens_of(text)
    if not len(t.span):
        return base, base
    p = marginals(field, t)
    label = np.where(p.max(axis=1) >= least, p.argmax(axis=1), 0)
    label[met(t, base) > 0] = 0
    linked = {int(b) for _, b in t.chain}
    added: list[Span] = []
    for k in np.flatnonzero(label).tolist():
        low, high = (int(x) for x in t.span[k])
        if added and k in linked and label[k - 1] == label[k] and label[k] - 1 in PLAUSIBLE:
            added[-1] = (added[-1][0], high, added[-1][2])
        else:
            added.append((low, high, int(label[k]) - 1))
    for kind, (fewest, most) in PLAUSIBLE.items():
        added = [s for s in added if s[2] != kind or fewest <= sum(c in "0123456789" for c in text[s[0] : s[1]]) <= most]
    added = _apart(added, base)
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1]))


def _apart(added: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``added`` that meet no base span."""
    merged = _flat(base)
    starts = [m[0] for m in merged]
    out = []
    for s in added:
        k = bisect_left(starts, s[1]) - 1
        if k < 0 or merged[k][1] <= s[0]:
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{(*KINDS, 'secret')[k]}:{low}:{high}" for low, high, k in spans)


def fit(docs: DataFrame, most: int = 3000) -> Field:
    """Train on at most ``most`` documents that hold a candidate token, by the hash of their id; on all tokens of each.

    Features are true or false, so that tokens alike are one row with a count, and edges are counts of label pairs: what reaches the
    driver follows the number of different tokens' shapes, not the texts.
    """
    hinted = docs.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = hinted.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(N_FEATURES, dtype=np.int64)
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                t = tokens_of(text or "")
                y = distant_labels(t, text or "", base_spans(text or ""))
                bits = t.x.astype(np.int64) @ powers
                found.update(("token", b, a) for b, a in zip(bits.tolist(), y.tolist(), strict=True) if a >= 0)
                for name, edges in (("chain", t.chain), ("skip", t.skip)):
                    found.update((name, a, b) for a, b in y[edges].tolist() if a >= 0 and b >= 0)
            rows = list(found)
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([found[r] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "a", "b", "n"])

    counted = in_arrow(hinted.join(F.broadcast(chosen), "doc_id").select("text"), run, "part string, a long, b long, n long")  # chosen: ``most`` rows at most
    rows = sorted(tuple(r) for r in counted.groupBy("part", "a", "b").agg(F.sum("n").alias("n")).collect())
    tokens = np.array([r[1:] for r in rows if r[0] == "token"], dtype=np.int64).reshape(-1, 3)
    edges = {name: np.zeros((N_LABELS, N_LABELS)) for name in ("chain", "skip")}
    for name, a, b, n in rows:
        if name in edges:
            edges[name][a, b] += n
    x = ((tokens[:, :1] >> np.arange(N_FEATURES)) & 1).astype(np.float64)
    return train(x, tokens[:, 1], tokens[:, 2], edges["chain"], edges["skip"])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """docs without text, plus n_email, n_ip, n_card, n_phone, ``base`` (the base spans), ``spans`` (all personal data) and ``secrets`` as kind:start:end, and n_all, the number of spans and secrets.

    Positions are code points, ends exclusive; spans that start alike stand in the order of KINDS. Null text counts as empty, a text
    of any length is read whole. Rows are judged one by one: repeated rows repeat, an empty table gives an empty one. Columns of
    those names in ``docs`` are replaced.
    """
    names = [f"n_{k}" for k in KINDS]
    more = ["base", "spans", "secrets"]
    kept = [c for c in docs.columns if c not in (*names, *more, "n_all", "text")]
    schema = docs.select(*kept).schema
    for n in names:
        schema = schema.add(n, "long")
    for n in more:
        schema = schema.add(n, "string")
    schema = schema.add("n_all", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [all_spans(t or "", field) for t in batch.column("text").to_pylist()]
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                private, secrets = ([[s for s in every if (s[2] == SECRET) == hidden] for _, every in found] for hidden in (False, True))
                strings = [pa.array([written(x) for x in xs], pa.string()) for xs in ([b for b, _ in found], private, secrets)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *counts, *strings, pa.array([len(e) for _, e in found], pa.int64())], [*kept, *names, *more, "n_all"])

    return in_arrow(docs.select(*kept, "text"), run, schema)
