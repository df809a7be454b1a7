"""Best-fit packing of token sequences by bin completion.

Documents are tokenized whole, end with a separator id and are cut into pieces only where they are longer
than a sequence. Packing works on the histogram of piece lengths, whose size is bounded by the
sequence length and not by the corpus: bin completion takes the largest length left, enumerates the fillings of the
room beside it that no other filling dominates, and applies the chosen filling as often as the counts
allow. Its incumbent is the best-fit-decreasing solution; a branch is cut once its waste can no longer
beat the incumbent. The resulting patterns form a table of at most a few rows per length, and pieces
find their place in it by their rank among the pieces of the same length.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lattica.llm.common import cut, in_arrow, long_parts, per_process, slices, texts_of

#: Split pattern of the tokenizer file's pre-tokenizer (a fixed value of that public file).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Numbered(dict):
    """Numbers keys in the order of their first lookup; ``new`` holds those not dealt with yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = k = len(self)
        self.new.append(key)
        return k


class WordTokenizer:
    """Token ids of a word-level BPE file, word by word, equal to those of the tokenizers library.

    White space never joins two tokens, so a text's ids are those of its words in turn. Words are kept with
    their ids in a table that is cut back at ``most`` words. A word unseen so far goes to the byte-pair
    merger of tiktoken, which is loaded with the file's own merges (the end-of-word mark is a byte of its own), if
    it is printable Latin, and to the tokenizers library itself otherwise.
    """

    MARK = "\x01"

    def __init__(self, path: str, most: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.split = regex.compile(_PIECES)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        mark = self.MARK.encode()

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if end else token)) + mark * end

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            if bytes([b]) != mark:
                ranks[bytes([b]) + mark] = len(ranks)
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{mark.decode()}]+{mark.decode()}", mergeable_ranks=ranks, special_tokens={})
        self.id_of, self.ends = np.zeros(len(ranks), dtype=np.uint32), np.zeros(len(ranks), dtype=bool)
        special = {t["content"] for t in json.loads(self.whole.to_str())["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in special and (k := ranks.get(raw(token))) is not None:
                self.id_of[k] = i
        for token, k in ranks.items():
            self.ends[k] = token.endswith(mark)
        self.known = _Numbered()
        self._clear()

    def _clear(self, keep: int = 0) -> None:
        """Start the table anew with the first ``keep`` words, which frequent ones are among."""
        first = list(self.known)[:keep] if keep else []
        self.known = _Numbered()
        self.known.update(zip(first, range(len(first)), strict=True))
        self.n = len(first)
        if first:
            self.used = int((self.start[: self.n] + self.size[: self.n]).max())
        else:
            self.flat, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _add(self, at: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Find the ids of the words numbered since the last call."""
        words, first = self.known.new, self.n
        self.known.new, self.n = [], len(self.known)
        while self.n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        quick, slow, pieces, counts = [], [], [], []
        for k, w in enumerate(words, first):
            s = w.decode("utf-8", "replace")
            low = s.lower()
            if low.isalpha() and max(low) < "ɐ":
                quick.append(k)
                pieces.append(low)
                counts.append(1)
            elif low.isprintable() and max(low) < "ɐ" and "<|" not in s:
                quick.append(k)
                parts = self.split.findall(low)
                pieces += parts
                counts.append(len(parts))
            else:
                slow.append((k, s))
        if quick:
            got = np.asarray(self.fast.encode_ordinary(self.MARK.join(pieces) + self.MARK) if pieces else [], dtype=np.int64)
            ends = np.concatenate([[0], np.flatnonzero(self.ends[got]) + 1])[np.concatenate([[0], np.cumsum(counts)])]
            self._add(quick, self.id_of[got], np.diff(ends))
        if slow:
            got = [e.ids for e in self.whole.encode_batch([s for _, s in slow], add_special_tokens=False)]
            self._add([k for k, _ in slow], np.asarray([i for x in got for i in x], dtype=np.uint32), np.asarray([len(x) for x in got]))

    def texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        if len(self.known) > self.most:
            self._clear(self.most // 3)
        index = self.known.__getitem__
        places = [np.fromiter(map(index, words), dtype=np.int64, count=len(words)) for words in map(bytes.split, texts)]
        if self.known.new:
            self._learn()
        for at in places:
            sizes = self.size[at]
            ends = np.cumsum(sizes)
            yield self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1])] if len(at) else np.zeros(0, dtype=np.uint32)


def tokenizer(path: str) -> WordTokenizer:
    """The one of this process."""
    return per_process(("tokenizer", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row of ``docs(doc_id, text)``.

    A null or empty text is the separator alone: one piece of length 1. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list] = [[], [], [], [], []]
                texts, doc_ids = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
                long = any(len(t) > 4 << 20 for t in texts)
                found = (np.concatenate(list(encode.texts(list(long_parts(t))))) for t in texts) if long else encode.texts(texts)
                for doc_id, ids in zip(doc_ids, found, strict=True):
                    raw, n = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little"), len(ids) + 1
                    for k, low in enumerate(range(0, n, room)):
                        high = min(n, low + room)
                        for o, x in zip(out, (doc_id, k, low, high - low, zlib.crc32(raw[4 * low : 4 * high])), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- packing the histogram ---


def best_fit(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths: [(lengths of a bin, how many such bins)]."""
    by_rest: dict[int, list[list]] = {}  # rest of a bin -> [[pattern, bins]]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        for rest in sorted(r for r in by_rest if r >= size):
            if not n:
                break
            each, left = rest // size, []
            for pattern, bins in by_rest.pop(rest):
                full = min(bins, n // each)
                if full:
                    by_rest.setdefault(rest - each * size, []).append([pattern + (size,) * each, full])
                    n -= full * each
                if full < bins and 0 < n < each:
                    by_rest.setdefault(rest - n * size, []).append([pattern + (size,) * n, 1])
                    full, n = full + 1, 0
                if full < bins:
                    left.append([pattern, bins - full])
            if left:
                by_rest.setdefault(rest, []).extend(left)
        each = room // size
        if n // each:
            by_rest.setdefault(room - each * size, []).append([(size,) * each, n // each])
        if n % each:
            by_rest.setdefault(room - (n % each) * size, []).append([(size,) * (n % each), 1])
    return [(p, b) for group in by_rest.values() for p, b in group]


def unavoidable(left: dict[int, int], sizes: list[int], room: int) -> int:
    """Room that no packing of ``left`` can use: large pieces against all that could stand beside them. ``sizes``: descending."""
    low, carry, waste = len(sizes) - 1, 0, 0
    for k, size in enumerate(sizes):
        rest = room - size
        if size <= rest or k > low:
            break
        while low > k and sizes[low] <= rest:
            carry += sizes[low] * left[sizes[low]]
            low -= 1
        short = rest * left[size] - carry
        waste, carry = waste + max(0, short), max(0, -short)
    return waste


def bound(left: dict[int, int], room: int) -> int:
    """Bins that any packing needs: all sizes and the unavoidable waste over the room of a bin."""
    sizes = sorted((s for s, n in left.items() if n), reverse=True)
    return -(-(sum(s * left[s] for s in sizes) + unavoidable(left, sizes, room)) // room)


def dominated(filling: tuple[int, ...], waste: int, left: dict[int, int], there: int) -> bool:
    """Whether one piece left over could take the place of some pieces of ``filling`` that fit into its own. ``there``: bit set of the sizes left.

    Swapped, the bin is as full or fuller with fewer or larger pieces, and the others fit where the one was: what remains is no harder.
    """
    one, more = 0, 0  # sums of one piece, of several
    for s in filling:
        more |= (more | one) << s
        one |= 1 << s
    for s, n in Counter(filling).items():
        if left[s] == n:
            there &= ~(1 << s)
    return any((more << d) & there or (d and (one << d) & there) for d in range(waste + 1))


class Work:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.steps = steps

    def step(self) -> bool:
        self.steps -= 1
        return self.steps > 0


def fillings(left: dict[int, int], sizes: list[int], room: int, most_waste: int, work: Work | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """(filling, waste): every undominated way to fill ``room`` from ``left`` with at most ``most_waste`` left over, least waste first.

    A piece that fits exactly dominates all others. Pairs come first among those without waste, as they are found without a
    table; the others come from sums that a bit set for each size shows to be reachable. Nothing is worked out before it is asked for.
    With ``work``, each filling looked at is a step, and the rest is left out once there are none.
    """
    work = work or Work(1 << 62)
    fit = sizes[bisect_left(sizes, -room, key=int.__neg__) :]
    if fit and fit[0] == room:
        yield (room,), 0
        return
    weight = 0
    for s in reversed(fit):
        weight += s * left[s]
        if weight > room:
            break
    if weight <= room:  # all that fit: nothing else is maximal
        if room - weight <= most_waste:
            yield tuple(s for s in fit for _ in range(left[s])), room - weight
        return
    for a in fit:
        if 2 * a < room:
            break
        if left.get(room - a, 0) > (2 * a == room):
            yield (a, room - a), 0
    there, reach = sum(1 << s for s in fit), [1] * (len(fit) + 1)
    mask = (1 << (room + 1)) - 1
    work.steps -= len(fit) // 16
    for k in range(len(fit) - 1, -1, -1):  # sums of pieces from the k-th size on
        sums, n, each = reach[k + 1], min(left[fit[k]], room // fit[k]), 1
        while n:
            each = min(each, n)
            sums |= (sums << (fit[k] * each)) & mask
            n, each = n - each, 2 * each
        reach[k] = sums

    def exact(k: int, rest: int, parts: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Ways to reach the sum ``rest`` by sizes from the k-th on, larger pieces first."""
        for j in range(max(k, bisect_left(fit, -rest, key=int.__neg__)), len(fit)):
            if not reach[j] >> rest & 1:
                return
            for n in range(min(left[fit[j]], rest // fit[j]), 0, -1):
                now, more = rest - n * fit[j], parts + (fit[j],) * n
                if not now:
                    yield more
                elif reach[j + 1] >> now & 1:
                    yield from exact(j + 1, now, more)

    for waste in range(min(most_waste, room) + 1):
        for filling in exact(0, room - waste, ()):
            if not work.step():
                return
            if waste or len(filling) > 2:
                used = Counter(filling)
                free = next((s for s in reversed(fit) if left[s] > used[s]), room + 1)  # the least piece that stays out
                if free > waste and not dominated(filling, waste, left, there):
                    yield filling, waste


def bin_completion(counts: dict[int, int], room: int, steps: int = 200_000, rounds: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """Bins for ``counts`` of lengths: [(lengths of a bin, how many such bins)].

    Branch and bound. The best-fit-decreasing packing is the incumbent. A node takes the largest length left, its branches are the
    undominated fillings beside it, each applied as often as the counts allow, then once less and so on; a filling branched on before is not
    taken again for that length, so no packing is met twice. A branch ends once its waste, with the waste that is
    unavoidable in the rest, cannot beat the incumbent. The first packing found replaces an incumbent that is as good, and the
    search ends where the incumbent meets the bound, or with all branches seen: then the result is optimal. ``steps``, nodes and fillings
    looked at, are shared by ``rounds`` of the search that differ in the order of branches; if none of them ends, the result
    is the best packing met, never a partial one.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    best, least = best_fit(counts, room), bound(counts, room)
    most = sum(n for _, n in best) + 1  # the first packing may be as good as the incumbent
    for k in range(rounds):
        found, ended = _search(counts, room, most, least, Work(steps // rounds), np.random.default_rng(k) if k else None)
        if found is not None:
            best = found
        most = sum(n for _, n in best)
        if ended or most <= least:
            break
    return best


def _search(counts: dict[int, int], room: int, most: int, least: int, work: Work, rng: np.random.Generator | None) -> tuple[list | None, bool]:
    """(the best packing in under ``most`` bins, whether nothing better is left), by one depth-first search."""
    left, used, total = dict(counts), 0, sum(s * n for s, n in counts.items())
    sizes = sorted(left, reverse=True)
    done: list[tuple[tuple[int, ...], int]] = []
    best: list | None = None

    def branches(banned: frozenset) -> Iterator[tuple[tuple[int, ...], int, frozenset]]:
        """(bin, times, fillings that a node below with the same largest length leaves out) at the present counts."""
        top, own = sizes[0], banned
        ways: Iterator | None = None
        ahead: list = []
        while True:
            # fillings are worked out with the largest piece taken; the counts are those of this node whenever it goes on
            left[top] -= 1
            if ways is None:
                ways = fillings(left, sizes if left[top] else sizes[1:], room - top, (most - 1 - used) * room - total, work)
            if rng is not None:  # a few at a time, in an order of chance
                if not ahead:
                    ahead = list(itertools.islice(ways, 3))
                    rng.shuffle(ahead)
                way = ahead.pop() if ahead else None
            else:
                way = next(ways, None)
            left[top] += 1
            if way is None:
                return
            filling, waste = (top, *way[0]), int(way[1])
            if filling not in own:
                need = Counter(filling)
                own = own | {filling}
                for times in range(min(left[s] // n for s, n in need.items()), 0, -1):
                    if waste * times <= (most - 1 - used) * room - total:
                        yield filling, times, own

    frames = [branches(frozenset())]
    while frames:
        if not work.step():
            return best, False
        branch = next(frames[-1], None)
        if branch is None:
            frames.pop()
            if done:
                _apply(left, sizes, done[-1], -1)
                used, total = used - done[-1][1], total + done[-1][1] * sum(done[-1][0])
                done.pop()
            continue
        filling, times, own = branch
        _apply(left, sizes, branch[:2], 1)
        done.append((filling, times))
        used, total = used + times, total - times * sum(filling)
        if not total:
            best, most = list(done), used
            if most <= least:
                return best, True
        elif used < most and total + unavoidable(left, sizes, room) <= (most - 1 - used) * room:
            frames.append(branches(own if sizes[0] == filling[0] else frozenset()))
            continue
        _apply(left, sizes, done[-1], -1)
        used, total = used - times, total + times * sum(filling)
        done.pop()
    return best, work.steps > 0


def _apply(left: dict[int, int], sizes: list[int], bins: tuple[tuple[int, ...], int], sign: int) -> None:
    """Take bins' pieces out of the counts (sign 1) or put them back (-1); ``sizes`` holds the lengths left, descending."""
    for s, n in Counter(bins[0]).items():
        before = left[s]
        left[s] = before - sign * n * bins[1]
        if not left[s]:
            del sizes[bisect_left(sizes, -s, key=int.__neg__)]
        elif not before:
            sizes.insert(bisect_left(sizes, -s, key=int.__neg__), s)


def slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, items a sequence, offset) that place every piece by its rank."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in bins:
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, taken[size], taken[size] + each * times, sequence, each, offset))
            taken[size] += each * times
            offset += size * each
        sequence += times
    return rows


def pack(parts: DataFrame, room: int = 2048, salts: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces(doc_id, piece, length, ...): their place in sequences of ``room``.

    Ranks among pieces of a length come from windows over (length, salt) and the counts of the salts before, so a
    length that most pieces share is not one task's; the salts follow from the most frequent length. Pieces alike take places in any
    order among themselves; repeated rows take places of their own. An empty table gives an empty one.
    """
    spark = parts.sparkSession
    parts = cut(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # room rows at most
    salts = salts or max(64, -(-max(counts.values(), default=0) // 20_000))
    places = spark.createDataFrame(slots(bin_completion(counts, room)), "length long, low long, high long, first long, each long, at long")
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_own", own).join(ahead, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_ahead"))
    # places has at most a few rows for each of the room lengths, whatever the corpus
    joined = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))).drop(places["length"])
    k = F.col("_rank") - F.col("low")
    return joined.withColumns({"sequence_id": F.col("first") + F.floor(k / F.col("each")).cast("long"), "offset": F.col("at") + (k % F.col("each")) * F.col("length")}).select(*parts.columns, "sequence_id", "offset")
