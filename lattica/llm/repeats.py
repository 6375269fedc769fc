"""Suffix-array dedup: maximal repeats of bytes, with all their occurrences, and the bytes that they cover.

A repeat is a string of WINDOW bytes or more that starts at two places or more, in one document or in several. Every byte
that a WINDOW-byte string covers goes if that string also starts anywhere else; all occurrences go, the first one too.

1. Each WINDOW-byte string has an anchor, the least hash among its GRAM-byte grams. Equal strings have equal anchors at
   equal places, so only occurrences of one anchor need to be compared. An anchor's context is all that strings with this
   anchor can hold, WINDOW - GRAM bytes before it and WINDOW from it on.
2. Anchors that occur once are dropped. Equal contexts are one leaf of their group's tree, and a leaf of two occurrences or
   more is a repeat as it stands. Both are sums over hashes, made before the shuffle.
3. A group's leaves, i.e. its contexts unlike each other, are put into an enhanced suffix array: their suffixes from the
   anchor on are sorted, with the lengths of the common prefixes of neighbours. A scan with a stack visits the tree of
   common-prefix intervals; at each interval the left extensions of its members are told apart, by their ranks among all
   left sides and the common lengths between these, and those that reach WINDOW bytes together with the prefix are
   occurrences of a repeat.
4. Groups of more than GROUP leaves are dealt to smaller trees before that: strings are filed by a longer core around the
   anchor, in steps that end with the whole string, where equal means repeated. Parts that occur twice or more are again
   leaves of their own, and only different ones go on. So no task gets a large group whole.

Defined results: a null text is empty; texts under WINDOW bytes lose nothing; a row that repeats another is a repeat of it,
and both go. Texts are told apart by 64 bits of hash of id and text, so that ids may be null or repeat. Strings are
compared by 128 bits of hash or byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_key, written
from .hashing import _byte_values, _powers, bytes_of, mix, slices

WINDOW, GRAM = 400, 32
BEFORE = WINDOW - GRAM
#: Contexts of an anchor that one suffix array takes; and how many neighbouring strings are filed together beyond that.
GROUP, WIDTHS = 4096, (93, 12, 1)
SLICE = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Prefix:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray, lane: int):
        self.p, self.q = _powers(_BASES[lane], len(data) + 1)
        self.s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(lane)[data] * self.p[: len(data)], out=self.s[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.s[end] - self.s[start]) * self.q[start])


def _anchor_places(grams: np.ndarray) -> np.ndarray:
    """Places that hold the least of the BEFORE + 1 grams of some window (the first of equal ones)."""
    n = BEFORE + 1
    if len(grams) < n:
        return np.zeros(0, np.int64)
    x = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    x = np.minimum(x[: len(x) - (n - size)], x[n - size :]) & np.uint64(0xFFFFFFFF)
    return x[np.concatenate([[True], x[1:] != x[:-1]])].astype(np.int64)


def anchors(rows: DataFrame) -> DataFrame:
    """(key, h, id, s, at, n): each anchor's hash, its context's hash, and the context: bytes s .. s + n of a text, the anchor at `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            data, offsets = bytes_of(batch.column("text"))
            one, two = _Prefix(data, 0), _Prefix(data, 1)
            at, of = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if b - a >= WINDOW:
                    place = np.arange(a, b - GRAM + 1)
                    own = _anchor_places(one(place, place + GRAM)) + a
                    at.append(own)
                    of.append(np.full(len(own), i))
            if not at:
                continue
            at, of = np.concatenate(at), np.concatenate(of)
            start, end = np.maximum(at - BEFORE, offsets[of]), np.minimum(at + WINDOW, offsets[of + 1])
            g = one(at, at + GRAM) ^ mix(two(at, at + GRAM))
            c = mix(one(start, end) + (at - start).astype(np.uint64)) ^ mix(two(start, end))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g.view(np.int64)),
                    pa.array(c.view(np.int64)),
                    batch.column("id").take(pa.array(of)),
                    pa.array((start - offsets[of]).astype(np.int64)),
                    pa.array((at - start).astype(np.int32)),
                    pa.array((end - start).astype(np.int32)),
                ],
                ["key", "h", "id", "s", "at", "n"],
            )

    return rows.mapInArrow(run, "key long, h long, id long, s long, at int, n int")


def _common(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the tree of common-prefix intervals; lcp[i] is that of suffixes i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            if length > 0:
                yield length, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


class _Least:
    """The least of any stretch of some numbers."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))
        self.table = np.full((len(self.rows), len(x)), np.iinfo(np.int64).max)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of start .. end, both included."""
        k = np.frexp((end - start + 1).astype(float))[1] - 1
        return np.minimum(self.table[k, start], self.table[k, end - (1 << k) + 1])


def _shared(contexts: list[tuple[bytes, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, members, back) of the common-prefix intervals of some contexts' suffixes from their cores on.

    contexts: their bytes, and where in them the core begins. members: the interval's contexts in the order of their left
    sides; back[i]: how many bytes before the core members i - 1 and i have in common. Only intervals with a repeat of
    WINDOW bytes or more.
    """
    right = [x[at:] for x, at in contexts]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    lcp = [0] + [_common(right[a], right[b]) for a, b in zip(order, order[1:])]
    left = [x[:at][::-1] for x, at in contexts]
    by_left = sorted(range(len(contexts)), key=left.__getitem__)
    least = _Least(np.array([0] + [_common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])]))
    rank = np.empty(len(contexts), np.int64)
    rank[by_left] = np.arange(len(contexts))
    ranks, by_left = rank[order], np.array(by_left)
    for length, i, j in intervals(lcp):
        own = np.sort(ranks[i : j + 1])
        back = np.concatenate([[0], least(own[:-1] + 1, own[1:])])
        if length + back.max() >= WINDOW:
            yield length, by_left[own], back


def maximal_repeats(contexts: list[tuple[bytes, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(context, start), ...]) of the repeats of WINDOW bytes or more across the cores of some contexts.

    Each repeat is given with all contexts that hold it; none of them can be extended to either side without losing one.
    """
    for length, members, back in _shared(contexts):
        # the same scan over the left extensions finds the members that agree on them, widest last
        for extent, a, b in _with_root(back.tolist()):
            if extent + length >= WINDOW:
                yield extent + length, [(m, contexts[m][1] - extent) for m in members[a : b + 1].tolist()]


def repeated_parts(contexts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the occurrences of maximal repeats, of each context's in an interval the longest alone."""
    out = []
    if len(contexts) == 2:
        (x, a), (y, b) = contexts
        back, length = _common(x[:a][::-1], y[:b][::-1]), _common(x[a:], y[b:])
        at = np.array([a, b] if back + length >= WINDOW else [], np.int64)
        return np.arange(len(at)), at - back, at + length
    at = np.array([at for _, at in contexts])
    for length, members, back in _shared(contexts):
        extent = np.maximum(back, np.append(back[1:], 0))
        own = extent + length >= WINDOW
        out.append((members[own], at[members[own]] - extent[own], at[members[own]] + length))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _with_root(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    yield from intervals(lcp)
    if len(lcp) > 1:
        yield 0, 0, len(lcp) - 1


def _covered(contexts: DataFrame) -> DataFrame:
    """(id, s, e): stretches of rows (key, id, base, at, x) that repeats cover; rows of a key share a core."""

    def group(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, start, end = repeated_parts([(x, at) for _, _, at, x in rows])
        base = np.array([r[1] for r in rows], np.int64)[of]
        return _joined(np.array([r[0] for r in rows], np.int64)[of], base + start, base + end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "s", "e"])

        for batch in batches:
            for k, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "id", "base", "at", "x")]):
                if k != key:
                    if len(held) > 1:
                        out.append(group(held))
                    key, held = k, []
                held.append(tuple(row))
            yield flush()
            out.clear()
        if len(held) > 1:
            out.append(group(held))
        yield flush()

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id long, s long, e long")


def _joined(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of stretches that touch, by what they are of."""
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    if not len(of):
        return of, start, end
    group = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]]))
    # the furthest end so far within each group
    far = np.maximum.accumulate(end + (group << 42)) - (group << 42)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > far[:-1])])
    return of[new], start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(of) - 1)]


def _cut(source: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """(key, m, id, base, at, x): the bytes of wanted stretches (key, m, *on, id, s, at, n).

    source: (*on, from, x), bytes of a text, or of a part of it that begins at `from`.
    """
    per = wanted.groupBy(*on).agg(F.collect_list(F.struct("key", "m", "id", "s", "at", "n")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, w in zip(*[batch.column(c) for c in ("from", "x", "w")]):
                first, x = first.as_py(), x.as_py()
                out = [(p["key"], p["m"], p["id"], p["s"], p["at"], x[p["s"] - first : p["s"] - first + p["n"]]) for p in w.as_py()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["key", "m", "id", "base", "at", "x"])

    return source.join(per, on).select("from", "x", "w").mapInArrow(run, "key long, m long, id long, base long, at int, x binary")


def _parts(contexts: DataFrame, width: int, core: int) -> DataFrame:
    """(key, h, id, s, at, n, of, base, core): the strings of contexts in parts of `width` neighbours, filed under the core that
    these share.

    contexts: (key, id, base, at, x), whose cores are `core` bytes from `at` on. A part is the bytes s .. s + n of its text,
    its own core begins `at` bytes into it, h is its hash, and of, base and core (key, base and at) say which context it is from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, i, base, at, x in zip(*[batch.column(c).to_pylist() for c in ("key", "id", "base", "at", "x")]):
                salt = key.to_bytes(8, "big", signed=True)
                # strings start at `at` or before, counted back from the core, so that equal strings fall into equal parts
                for back in range(0, WINDOW - core + 1, width):
                    a = at - back
                    b = a - width + 1 + WINDOW
                    if a < 0 or b > len(x):  # no string of this part lies inside the text
                        continue
                    first, last = max(0, a - width + 1), min(a, len(x) - WINDOW)
                    h = hashlib.blake2b(x[a:b], digest_size=8, key=salt + back.to_bytes(2, "big")).digest()
                    own = hashlib.blake2b(x[first : last + WINDOW], digest_size=8, salt=(a - first).to_bytes(2, "big")).digest()
                    out.append((int.from_bytes(h, "big", signed=True), int.from_bytes(own, "big", signed=True), i, base + first, a - first, last + WINDOW - first, key, base, at))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            names = ["key", "h", "id", "s", "at", "n", "of", "base", "core"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names)

    return contexts.select("key", "id", "base", "at", "x").mapInArrow(run, "key long, h long, id long, s long, at int, n int, of long, base long, core int")


def _told_apart(source: DataFrame, found: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """What of stretches (key, h, id, s, at, n, *on) is repeated as it stands, and the bytes of those that need a closer look.

    The first is spans (id, s, e). The second has, for each key with stretches unlike each other of which one at least isn't
    covered as it stands, each different stretch once, and their number m. Sums are written before they are joined, so that
    Spark can split the other side of the join where one key is frequent.
    """
    place = list(dict.fromkeys([*on, "id", "s", "at", "n"]))
    kinds = written(found.groupBy("key", "h").agg(F.count(F.lit(1)).alias("t"), F.min(F.struct(*place)).alias("rep")))
    again = written(found.join(kinds.where("t > 1").select("key", "h"), ["key", "h"]).select("id", "s", (F.col("s") + F.col("n")).alias("e")))
    mixed = written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("t").alias("least")).where("m > 1 and least = 1").select("key", "m"))
    cut = written(_cut(source, kinds.join(mixed, "key").select("key", "m", "rep.*"), on))
    dropped(kinds, mixed)
    return again, cut


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, starts, ends): for each text with any, the maximal stretches of bytes that repeats cover; id is its `text_key`."""
    rows = docs.select(text_key(doc_id, text).alias("id"), F.col(text).alias("text"))
    every = written(anchors(rows))
    twice = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("key"))
    found = written(every.join(twice, "key"))
    dropped(every, twice)
    texts = rows.select("id", F.lit(0).cast("long").alias("from"), F.col("text").cast("binary").alias("x"))
    again, cut = _told_apart(texts, found, ["id"])
    dropped(found)
    spans, core = [again, written(_covered(cut.where(F.col("m") <= GROUP)))], GRAM
    for width in WIDTHS:
        large = cut.where(F.col("m") > GROUP)
        if large.isEmpty():
            break
        found = written(_parts(large, width, core))
        core = WINDOW - width + 1
        if width == 1:
            # a whole string is its own core: equal ones are repeats
            twice = written(found.groupBy("key", "h").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("key", "h"))
            spans.append(written(found.join(twice, ["key", "h"]).select("id", "s", (F.col("s") + F.col("n")).alias("e"))))
            dropped(found, twice)
            break
        contexts = large.select("id", "base", F.col("key").alias("of"), F.col("at").alias("core"), F.col("base").alias("from"), "x")
        again, parts = _told_apart(contexts, found, ["id", "base", "of", "core"])
        dropped(found, cut)
        cut = parts
        spans += [again, written(_covered(cut.where(F.col("m") <= GROUP)))]
    dropped(cut)
    merged = written(_merged(functools.reduce(DataFrame.union, spans)))
    dropped(*spans)
    return merged


def _united(spans) -> list[list[int]]:
    """The unions of stretches (start, end) that touch, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """(id, starts, ends) of the unions of stretches (id, s, e)."""
    per_text = spans.distinct().groupBy("id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for s, e in zip(batch.column("s").to_pylist(), batch.column("e").to_pylist()):
                own = _united(zip(s, e))
                starts.append([x for x, _ in own])
                ends.append([y for _, y in own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["id", "starts", "ends"])

    return per_text.mapInArrow(run, "id long, starts array<bigint>, ends array<bigint>")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, joined) of every row."""
    spans = repeated_spans(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(spans, text_key("doc_id", "text") == F.col("id"), "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = defaultdict(list)
            for t, a, b in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                t, a, b = t or b"", a or [], b or []
                kept = b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)]))
                for name, v in zip(("n_bytes", "n_removed", "n_spans", "kept"), (len(t), len(t) - len(kept), len(a), kept)):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()]], ["doc_id", *out])

    return rows.mapInArrow(run, rows.schema[0].simpleString().replace(":", " ", 1) + ", n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_removal_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
