"""Substring dedup by relative Lempel-Ziv parsing against an index of all earlier text.

A document's factors copy earlier text; those of WINDOW words or more are its duplicate spans. Earlier means a smaller
doc_id, or the same document and an earlier start. The reference, which is the corpus itself, is indexed in blocks, and every
document is matched against every block that can hold one of its phrases. What decides is a join of windows with the blocks;
the parse then joins the windows' pointers into factors, so that a factor isn't always the longest match there is:

1. Each window of WINDOW words has an anchor, the least hash among its GRAM-word grams. Equal windows have equal anchors,
   so the anchor's hash names the block of the index that windows are filed in. Neighbouring windows mostly share an
   anchor and travel as one run. Windows that occur twice in a slice of a task's text are resolved there and only the
   first is filed; the task remembers it for its next slices, so that a window of very many documents is filed about
   once a task. Any earlier occurrence will do as a pointer, so what a task forgets changes no result.
2. A block sorts its windows and gives each later occurrence a pointer to the first one, in runs again.
3. A document's runs are parsed: a factor goes on while its windows point to consecutive places of one source; where that
   ends, the windows across the boundary begin factors of their own, which may overlap the last, so that no window that
   lies over a boundary is lost. The union of the factors is what the windows cover.

Anchors so frequent that one block would get a large part of the corpus are found on a sample and their windows are filed
by their own hash instead, one by one. A sample that misses one makes a block larger, never the result different.

Defined results: a null text has no words; texts of fewer than WINDOW words lose nothing. Each row is judged by its own
text: rows that repeat an id and its text count as one document, whose windows are not repeats of themselves; texts unlike
each other under one id are documents of their own, in the order of a hash. A null doc_id orders before all others. Windows
are compared by 48 bits of hash among those with an equal 64-bit anchor; those of frequent anchors by 64 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import Words, mix, rolling, slices

WINDOW, GRAM = 20, 8
#: Bytes of text whose windows a block of the index holds, about.
BLOCK_BYTES = 24_000_000
#: Windows met more than once that a task goes on knowing, the latest met; one it forgets is filed again.
KNOWN = 100_000
#: One document in so many is looked at for frequent anchors; an anchor counts as such from this many windows there.
SAMPLE, FREQUENT = 64, 400
NULL_ID = -(1 << 63)
_RUN = np.dtype([("start", "<i4"), ("count", "<i4"), ("doc", "<i8"), ("th", "<i8"), ("at", "<i4")])


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, anchor, hash) of every window."""
    w = Words(texts)
    h, at = w.windows(WINDOW)
    grams = rolling(w.hashes, GRAM)
    anchor = _sliding_min(grams, WINDOW - GRAM + 1)[at] if len(at) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), np.maximum(w.counts() - (WINDOW - 1), 0))
    return text, (at - w.first[text]).astype(np.int32), anchor, h


def _resolve(key: np.ndarray, h: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows that occurred before, and of the first occurrence of each."""
    # only keys that occur twice are sorted in full
    order = np.argsort(key, kind="stable")
    k = key[order]
    twin = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    some = order[twin]
    some = some[np.lexsort((start[some], th[some], doc[some], h[some], key[some]))]
    head = np.ones(len(some), bool)
    head[1:] = (key[some][1:] != key[some][:-1]) | (h[some][1:] != h[some][:-1])
    first = some[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(some) else some
    later = (doc[some] != doc[first]) | (th[some] != th[first]) | (start[some] != start[first])
    return some[later], first[later]


def _runs(doc: np.ndarray, th: np.ndarray, start: np.ndarray, source: np.ndarray) -> np.ndarray:
    """(doc, th, _RUN...) of windows whose pointers are source (doc, th, at): neighbours that point to neighbours become one."""
    order = np.lexsort((source["at"], start, th, doc))
    doc, th, start, source = doc[order], th[order], start[order], source[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1) | (source["at"][1:] != source["at"][:-1] + 1)
    new[1:] |= (source["doc"][1:] != source["doc"][:-1]) | (source["th"][1:] != source["th"][:-1])
    heads = np.flatnonzero(new)
    out = source[heads].copy()
    out["start"], out["count"] = start[heads], np.diff(np.append(heads, len(doc)))
    return doc[heads], th[heads], out


def _by_doc(doc: np.ndarray, th: np.ndarray, runs: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])) if len(doc) else np.zeros(0, int)
    return doc[cuts].tolist(), th[cuts].tolist(), [runs[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(doc)))]


def _pointed(later: np.ndarray, first: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """The runs of each document that has windows with an earlier occurrence."""
    source = np.zeros(len(first), _RUN)
    source["doc"], source["th"], source["at"] = doc[first], th[first], start[first]
    return _by_doc(*_runs(doc[later], th[later], start[later], source))


#: A row files windows in a block (keys and so on), or carries resolved runs of a document through the same shuffle.
_FILED = "block long, doc long, th long, runs binary, keys binary, docs binary, ths binary, starts binary, counts binary, hashes binary"
_NAMES = [x.split()[0] for x in _FILED.split(", ")]


def _file(rows: DataFrame, blocks: int, frequent) -> DataFrame:
    """Each task's windows, packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        # (key, hash, doc, th, start) of windows that are filed already
        known = [np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64, np.int64, np.int32)]
        for batch in slices(batches):
            text, start, key, h = _windows(batch.column("text"))
            doc, th = (batch.column(c).to_numpy()[text] for c in ("id", "th"))
            if len(often):
                k = np.minimum(np.searchsorted(often, key), len(often) - 1)
                key = np.where(often[k] == key, mix(h), key)
            h = h >> np.uint64(16)
            n_known = len(known[0])
            both = [np.concatenate(x) for x in zip(known, (key, h, doc, th, start))]
            later, first = _resolve(*both)
            # a known window that turns out later is resolved in its block, where it is filed
            own = later >= n_known
            done = _pointed(later[own], first[own], *both[2:])
            left = np.ones(len(h), bool)
            left[later[own] - n_known] = False
            met = np.unique(first)
            idle = np.ones(n_known, bool)
            idle[met[met < n_known]] = False
            idle[later[~own]] = False
            known = [np.concatenate([x[:n_known][idle], x[met]])[-KNOWN:] for x in both]
            text, start, key, h, doc, th = text[left], start[left], key[left], h[left], doc[left], th[left]
            new = np.ones(len(h), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(h)))
            block = (mix(key[heads]) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.unique(block))
            out: dict[str, list] = {n: [] for n in _NAMES}
            six = h.view(np.uint8).reshape(-1, 8)[:, :6]
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                own = order[a:b]
                n = counts[own]
                each = np.repeat(heads[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                values = (int(block[own[0]]), None, None, None, key[heads[own]], doc[heads[own]], th[heads[own]], start[heads[own]], n.astype(np.int32), np.ascontiguousarray(six[each]))
                for name, v in zip(_NAMES, values):
                    out[name].append(v.tobytes() if isinstance(v, np.ndarray) else v)
            for i, t, r in zip(*done):
                for name, v in zip(_NAMES, (hash((i, t)) % blocks, i, t, r, *[None] * 6)):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64() if n in ("block", "doc", "th") else pa.binary()) for n in _NAMES], _NAMES)

    return rows.mapInArrow(run, _FILED)


def _look_up(table: pa.Table) -> pa.Table:
    """One block: the runs of every document that has windows with an earlier occurrence in it."""
    filed = table.filter(table.column("keys").is_valid())
    carried = table.filter(table.column("doc").is_valid())

    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(filed.column(name).to_pylist()), kind)

    counts = joined("counts", np.int32)
    nth = np.arange(counts.sum(dtype=np.int64)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
    h = np.zeros((len(nth), 8), np.uint8)
    h[:, :6] = joined("hashes", np.uint8).reshape(-1, 6)
    key, doc, th = (np.repeat(joined(name, kind), counts) for name, kind in (("keys", np.uint64), ("docs", np.int64), ("ths", np.int64)))
    start = (np.repeat(joined("starts", np.int32), counts) + nth).astype(np.int32)
    later, first = _resolve(key, h.view(np.uint64).ravel(), doc, th, start)
    found = _pointed(later, first, doc, th, start)
    names = (("doc", pa.int64()), ("th", pa.int64()), ("runs", pa.binary()))
    return pa.table({n: pa.array([*x, *carried.column(n).to_pylist()], kind) for x, (n, kind) in zip(found, names)})


def parse(runs: np.ndarray) -> np.ndarray:
    """The factors of a document, as (start, words, source doc, source start), from the runs of its windows.

    Greedy: from the left, each factor is as long as its source goes on. A window that isn't inside the last factor
    begins the next one, even where the two overlap.
    """
    runs = np.sort(runs, order=("start", "count"))
    out = []
    for start, count, doc, th, at in runs.tolist():
        if out and out[-1][2:4] == [doc, th] and out[-1][4] - out[-1][0] == at - start and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + count - out[-1][0])
        else:
            out.append([start, count, doc, th, at])
    return np.array([(s, n + WINDOW - 1, d, a) for s, n, d, _, a in out], np.int64).reshape(-1, 4)


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, factors): each document's duplicate spans, an array of (start, words, source_doc, source_start); th is a hash
    of its text."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k, n = np.unique(_windows(batch.column("text"))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(anchors, "k long, n long")
    # the sum of all counts bounds how many can be frequent
    often = sample.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(FREQUENT, size // SAMPLE // 1_000_000))).select("k").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)))
    found = _file(rows, blocks, frequent).groupBy("block").applyInArrow(_look_up, "doc long, th long, runs binary")
    found = found.groupBy("doc", "th").agg(F.collect_list("runs").alias("runs"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "words", "source_doc", "source_start")
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        for batch in batches:
            each = [[dict(zip(names, f)) for f in parse(np.frombuffer(b"".join(r), _RUN)).tolist()] for r in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(each, kind)], ["id", "th", "factors"])

    return found.mapInArrow(parsed, "id long, th long, factors array<struct<start: long, words: long, source_doc: long, source_start: long>>")


def _with_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, starts, words): every row with its duplicate spans, null where it has none."""
    spans = written(factors(docs, doc_id, text).select("id", "th", F.col("factors.start").alias("starts"), F.col("factors.words").alias("words")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("id")) & (F.xxhash64("text") == F.col("th"))
    return rows.join(spans, same, "left").drop("id", "th")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the remaining words, joined by one space) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = (batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("words").to_pylist())
            totals, removed, kept = [], [], []
            for t, starts, words in zip(*columns):
                own = (t or b"").split()
                totals.append(len(own))
                left, at, n = [], 0, 0
                for s, k in sorted(zip(starts or (), words or ())):
                    left += own[at:s]
                    n += max(0, min(s + k, len(own)) - max(at, s))
                    at = max(at, s + k)
                left += own[at:]
                removed.append(n)
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    rows = _with_spans(docs, doc_id, text)
    return rows.mapInArrow(run, rows.schema[0].simpleString().replace(":", " ", 1) + ", n_words long, n_removed long, kept_text string")


def substring_dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
