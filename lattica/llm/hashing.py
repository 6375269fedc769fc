"""Word and word-window hashes of many texts at once, as numpy over Arrow buffers.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes. A word's hash is a polynomial over its bytes, taken from prefix sums
modulo 2**64 and mixed; a window's is the same over its words' hashes. Cost is a few array passes, whatever the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 500_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: With punctuation as white space too: only letters, digits and bytes of other scripts make words.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 1)

        def run(b: int) -> np.ndarray:
            p = np.full(n, b, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)

        have = _POWERS[base] = (run(base), run(pow(base, -1, 1 << 64)))
    return have


_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def rolling(values: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Mixed hashes of every k consecutive values (len - k + 1 of them, or none)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = _powers(base, n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(values * p[:n], out=s[1:])
    return mix((s[k:] - s[:-k]) * q[: n - k + 1])


class Words:
    """The words of some texts: `hashes` of all, and text i's are hashes[first[i]:first[i + 1]].

    starts, ends: byte positions of the words within `data`; offsets: of the texts.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, seed: int = 0, marks: bool = False):
        self.data, self.offsets = bytes_of(texts)
        data = _LOWER[self.data] if lower else self.data
        space = (_IS_MARK if marks else _IS_SPACE)[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.ones(n + 1, bool)
        before[1:] = space
        before |= edge  # a word starts where the byte before is a space, or where a text starts
        word = ~space
        self.starts = np.flatnonzero(word & before[:-1])
        after = np.ones(n + 1, bool)
        after[:-1] = space
        after |= edge
        self.ends = np.flatnonzero(word & after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        p, q = _powers(_BYTE_BASE, n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(seed)[data] * p[:n], out=s[1:])
        self.hashes = mix((s[self.ends] - s[self.starts]) * q[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows that lie in one text, and the place of each window's first word."""
        h = rolling(self.hashes, k)
        counts = np.maximum(self.counts() - (k - 1), 0)
        at = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return h[at], at


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts (null: empty) in one array, and where each text begins and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = bytes_of(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
