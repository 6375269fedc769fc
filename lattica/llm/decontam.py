"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits, A-Z in lower case (bytes of other scripts count as letters). A seed is the hash of
five tokens under a fixed mask that ignores some positions between them. The seeds of the benchmark and of the documents
are joined on (mask, hash); each hit names a diagonal, i.e. how document and item lie on each other, and the diagonal is
verified token by token: a document is contaminated by an item if some WINDOW aligned tokens (or the whole item, if that
is shorter) match in 80 of 100 places or more. The three masks hit every such overlap of 10 to 20 tokens, wherever its
substitutions are, as the tests check exhaustively.

The benchmark is taken in blocks of bounded size. A block's index is broadcast, so that documents are never shuffled;
more blocks mean more passes, not more memory.

A seed that many items share makes many hits; these are verified together, as arrays, in runs of bounded size, and what an
item overlaps on several diagonals is kept as one stretch.

Defined results: null or empty texts, and items without tokens, match nothing; items that repeat are
reported under each of their ids; repeated rows are judged one by one. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written
from .hashing import Words, mix, slices

#: Token positions that a seed compares, in its first eight.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
WINDOW, PERCENT, MIN_TOKENS = 20, 80, 10
#: Characters of benchmark text whose index is broadcast at once.
BLOCK_CHARS = 8_000_000
#: Hits of seeds that are spread out over items at once, and tokens that they align at once.
HITS, TOKENS = 1_000_000, 4_000_000
_FILTER_BITS = 20


def _seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The seed that begins at each word, as far as the mask fits into the words."""
    n = len(words) - max(mask)
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for p in mask:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[p : p + n]
    return mix(h)


class Index:
    """Seeds and tokens of one block of the benchmark."""

    def __init__(self, ids: list, texts: list):
        w = Words(pa.array(texts, pa.string()), lower=True, marks=True)
        self.ids, self.words, self.first = ids, w.hashes, w.first
        hashes, items, places, before = [], [], [], []
        short = {int(n) for n in w.counts() if 0 < n < MIN_TOKENS}
        #: (mask, number) of all seeds, and of the short items' the number of their tokens
        self.masks = [(m, n, 0) for n, m in enumerate(MASKS)] + [(tuple(range(n)), len(MASKS) + n, n) for n in sorted(short)]
        for mask, number, tokens in self.masks:
            for i in range(len(ids)):
                own = w.hashes[w.first[i] : w.first[i + 1]]
                if len(own) == tokens if tokens else len(own) >= MIN_TOKENS:
                    hashes.append(h := _seeds(own, mask, number))
                    items.append(np.full(len(h), i))
                    places.append(np.arange(len(h)))
                    before.append(np.append(np.zeros(1, np.uint64), h[:-1])[: len(h)])
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        before = np.concatenate([np.zeros(0, np.uint64), *before])
        #: seeds sorted by hash and then by the seed one token earlier; as one number, `pairs`
        self.seeds, self.before = np.unique(self.hashes), np.unique(before)
        self.pairs = np.searchsorted(self.seeds, self.hashes) * len(self.before) + np.searchsorted(self.before, before)
        order = np.argsort(self.pairs, kind="stable")
        self.hashes, self.pairs = self.hashes[order], self.pairs[order]
        self.items = np.concatenate([np.zeros(0, np.int64), *items])[order]
        self.places = np.concatenate([np.zeros(0, np.int64), *places])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def overlaps(self, texts: pa.Array) -> np.ndarray:
        """Rows (text, item, start, tokens, matches), in order: the stretches of a text that an item overlaps.

        On a diagonal, a stretch is all that matching windows cover, and the matches are those within it. Stretches of an item
        on other diagonals that meet it are one with it; it then has the matches of the best of them.
        """
        w = Words(texts, lower=True, marks=True)
        good, held = [np.zeros((0, 5), np.int64)], []
        # text, item and shift as one number
        long = int(np.diff(self.first).max(initial=0))
        span = int(w.counts().max(initial=0)) + long + 1

        def verified() -> None:
            code = np.unique(np.concatenate(held))
            text, item = np.divmod(code // span, len(self.ids))
            good[:] = [_merged(np.concatenate([*good, self._verified(w, np.stack([text, item, code % span - long], axis=1))]))]
            held.clear()

        for mask, number, _ in self.masks:
            h = _seeds(w.hashes, mask, number)
            near = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
            doc = np.searchsorted(w.first, near, "right") - 1
            whole = near + max(mask) < w.first[doc + 1]
            near, doc = near[whole], doc[whole]
            low, high = np.searchsorted(self.hashes, h[near], "left"), np.searchsorted(self.hashes, h[near], "right")
            near, doc, low, high = (x[low < high] for x in (near, doc, low, high))
            # where the seed one token earlier hits as well, that one stands for the diagonal
            earlier = np.where(near > w.first[doc], h[near - 1], np.uint64(1))
            place = np.minimum(np.searchsorted(self.before, earlier), max(0, len(self.before) - 1))
            pair = np.searchsorted(self.seeds, h[near]) * len(self.before) + place
            same = self.before[place] == earlier if len(near) else np.zeros(0, bool)
            first, end = (np.where(same, np.searchsorted(self.pairs, pair, side), low) for side in ("left", "right"))
            near, doc = np.tile(near, 2), np.tile(doc, 2)
            low, high = np.concatenate([low, end]), np.concatenate([first, high])
            upto = np.cumsum(high - low)
            # a seed that many items have may make many hits of each place: taken, and verified, in bounded runs
            for run in range(0, int(upto[-1]) if len(upto) else 0, HITS):
                a, b = np.searchsorted(upto, (run, run + HITS), "right")
                part = slice(a, b + 1)
                n = (high - low)[part]
                k = np.repeat(low[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                d = np.repeat(doc[part], n)
                held.append((d * len(self.ids) + self.items[k]) * span + (np.repeat(near[part], n) - w.first[d] - self.places[k] + long))
                if sum(map(len, held)) > 4 * HITS:
                    verified()
        if held:
            verified()
        return good[0]

    def _verified(self, w: Words, hits: np.ndarray) -> np.ndarray:
        """The rows (text, item, start, tokens, matches) of hits (text, item, shift) with a window that matches."""
        doc, item, shift = hits.T
        own, other = w.counts()[doc], np.diff(self.first)[item]
        size, lo = np.minimum(WINDOW, other), np.maximum(0, shift)
        length = np.minimum(own, shift + other) - lo
        fits = length >= size
        doc, item, shift, size, lo, length, other = (x[fits] for x in (doc, item, shift, size, lo, length, other))
        need = np.where(other >= MIN_TOKENS, PERCENT, 100) * size
        out, ends = [np.zeros((0, 5), np.int64)], np.cumsum(length)
        at = 0
        while at < len(doc):
            # as many hits as have TOKENS aligned tokens, one at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
            n, c = length[at:to], slice(at, to)
            start = np.cumsum(n) - n
            hit, off = np.repeat(np.arange(to - at), n), np.arange(n.sum()) - np.repeat(start, n)
            a = w.hashes[(w.first[doc[c]] + lo[c])[hit] + off]
            b = self.words[(self.first[item[c]] + lo[c] - shift[c])[hit] + off]
            same = np.concatenate([[0], np.cumsum(a == b)])
            window = off <= (n - size[c])[hit]
            place = np.flatnonzero(window)
            full = 100 * (same[place + size[c][hit[place]]] - same[place]) >= need[c][hit[place]]
            place = place[full]
            if len(place):
                of = hit[place]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                last = np.append(first[1:], len(of)) - 1
                found = of[first]
                begin, end = place[first], place[last] + size[c][found]
                out.append(np.stack([doc[c][found], item[c][found], lo[c][found] + off[begin], end - begin, same[end] - same[begin]], axis=1))
            at = to
        return np.concatenate(out)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows (text, item, start, tokens, matches) with those of one text and item that meet as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    key = np.cumsum(np.any(np.diff(rows[:, :2], axis=0, prepend=-1) != 0, axis=1))
    # ends, kept apart by their key, so that the running largest doesn't cross from one key to the next
    span = int((rows[:, 2] + rows[:, 3]).max()) + 1
    reach = np.maximum.accumulate(key * span + rows[:, 2] + rows[:, 3])
    new = np.append(True, (key * span + rows[:, 2])[1:] > reach[:-1])
    at = np.flatnonzero(new)
    end = reach[np.append(at[1:], len(rows)) - 1] - key[at] * span
    return np.stack([rows[at, 0], rows[at, 1], rows[at, 2], end - rows[at, 2], np.maximum.reduceat(rows[:, 4], at)], axis=1)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (text, item, stretches, tokens of the longest) of merged rows, which are in order."""
    if not len(rows):
        return rows[:, :4]
    at = np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0, prepend=-1) != 0, axis=1))
    return np.stack([rows[at, 0], rows[at, 1], np.diff(at, append=len(rows)), np.maximum.reduceat(rows[:, 3], at)], axis=1)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, spans: bool = False) -> tuple[DataFrame, str]:
    """The document rows, with all columns or those to keep, and an array of item_id, stretches, tokens (of the longest); its name.

    With `spans`, the array has item_id, start, tokens, matches of each stretch.

    A row gets its own hits where its text is read, so that neither null ids nor ids that repeat matter.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    (hits,) = fresh(docs, "hits")
    keep = docs.columns if keep is None else keep
    for block in range(blocks):
        # bounded by BLOCK_CHARS on average
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in own], [r[1] for r in own]))
        names = keep if block == blocks - 1 else list(dict.fromkeys([*keep, text]))
        kind = T.StructType([*[docs.schema[c] for c in names], T.StructField(hits, T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in _FIELDS[spans]])))])
        docs = docs.mapInArrow(_matcher(index, text, names, hits, spans), kind)
        if block < blocks - 1:
            docs = written(docs)  # else the indices of all blocks are in memory at once
    return docs, hits


#: What a hit has, summed by item or as it lies in the text.
_FIELDS = (("item_id", "stretches", "tokens"), ("item_id", "start", "tokens", "matches"))


def _matcher(shared, text: str, names: list[str], hits: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        fields = _FIELDS[spans]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in fields]))
        for batch in slices(batches, text):
            made = index.overlaps(batch.column(text))
            made = made if spans else _summed(made)
            counts = np.bincount(made[:, 0], minlength=batch.num_rows)
            values = [pa.array(index.ids, pa.int64()).take(pa.array(made[:, 1])), *[pa.array(x) for x in made.T[2:]]]
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays(values, fields))
            if hits in batch.schema.names:  # of the blocks before
                own = pa.array([x + y for x, y in zip(batch.column(hits).to_pylist(), own.to_pylist())], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], own.cast(kind)], [*names, hits])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, hits (array of item_id, start, tokens, matches)."""
    out, hits = with_hits(docs, benchmark, text, [doc_id], spans=True)
    return out.select(F.col(doc_id).alias("doc_id"), F.col(hits).alias("hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no benchmark item contaminates, with the columns they came with."""
    out, hits = with_hits(docs, benchmark, text)
    return out.where(F.size(hits) == 0).drop(hits)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted), n_overlaps (stretches of any item), max_tokens (of the longest)."""
    out, name = with_hits(docs, benchmark, "text", ["doc_id"])
    hits = F.col(name)
    return out.select(
        "doc_id",
        (F.size(hits) > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(hits["item_id"])).alias("item_ids"),
        F.aggregate(hits["stretches"], F.lit(0).cast("long"), lambda a, n: a + n).alias("n_overlaps"),
        F.coalesce(F.array_max(hits["tokens"]), F.lit(0)).cast("long").alias("max_tokens"),
    )
