"""Exact nearest vectors: matrix products find who may be near, and the distances of those are summed one by one.

A product of rounded numbers is off by less than a bound that follows from the vectors' lengths, so that a row whose product
is beyond the k-th distance by more than that can't be among the k nearest. What is left, some k rows a query, gets its
distance as SQL has it: squares of differences of doubles, added from the first element on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Queries and rows of one product, pairs whose distances are summed at once, and the rows that a task begins with.
QUERIES, ROWS, PAIRS, FIRST = 1024, 8192, 500_000, 512
#: Values beyond this have no squares in single precision that could be added up.
MOST = 1e15
_NAN, _NULL, _NONE = 1, 2, 3


class Vectors:
    """ids and vectors (null, of any lengths, with nulls in them) as `x`, one column a vector, and `has`, where it has a value."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, dims: int = 0):
        self.ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.dims = max(int(size.max(initial=0)), dims)
        self.even = np.ones(len(size), bool)
        if (size == self.dims).all() and not flat.null_count:
            self.x, self.has = np.ascontiguousarray(values.reshape(len(size), self.dims).T), None
        else:
            at = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            self.x, self.has = np.zeros((self.dims, len(size))), np.zeros((self.dims, len(size)), bool)
            self.has[at[1], at[0]] = flat.is_valid().to_numpy(zero_copy_only=False)
            self.x[at[1], at[0]] = values
            self.x[~self.has] = 0
            self.even = self.has.all(0)
        with np.errstate(invalid="ignore"):
            self.even = self.even & (np.abs(self.x) <= MOST).all(0)
        self.square = (np.where(self.even, self.x, 0) ** 2).sum(0)

    def taken(self, at: np.ndarray) -> Vectors:
        out = Vectors.__new__(Vectors)
        out.ids, out.dims, out.x, out.even, out.square = self.ids[at], self.dims, self.x[:, at], self.even[at], self.square[at]
        out.has = None if self.has is None else self.has[:, at]
        return out

    def padded(self, dims: int) -> Vectors:
        if dims == self.dims or not len(self.ids):
            return self
        out, more = self.taken(np.arange(len(self.ids))), ((0, dims - self.dims), (0, 0))
        out.has = np.pad(np.ones(self.x.shape, bool) if self.has is None else self.has, more)
        out.x, out.dims, out.even, out.square = np.pad(self.x, more), dims, np.zeros(len(self.ids), bool), np.zeros(len(self.ids))
        return out

    def without_crowds(self, k: int) -> Vectors:
        """Of equal vectors the rows with the smallest ids: k, and as many as one id has."""
        rows = np.ascontiguousarray(self.x.T)
        if self.has is not None or not self.dims:
            return self
        _, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * self.dims))).ravel(), return_inverse=True)
        order = np.lexsort((self.ids, same))
        first = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
        if len(first) == len(order):
            return self
        new = np.flatnonzero(np.r_[True, (np.diff(same[order]) != 0) | (np.diff(self.ids[order]) != 0)])
        times = int(np.diff(np.r_[new, len(order)]).max())
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        return self.taken(np.sort(order[rank < k + times]))


class Nearest:
    """The k nearest, so far, of each query: by distance (then those that are no number, then those without one), then by id."""

    def __init__(self, queries: Vectors, k: int):
        self.q, self.k = queries, k
        shape = (len(queries.ids), k)
        self.kind, self.d, self.j = np.full(shape, _NONE, np.int8), np.zeros(shape), np.zeros(shape, np.int64)

    def put(self, s: Vectors, qi: np.ndarray, sj: np.ndarray) -> None:
        """Pairs of places in the queries and in `s`."""
        for a in range(0, len(qi), PAIRS):
            self._put(s, qi[a : a + PAIRS], sj[a : a + PAIRS])

    def _put(self, s: Vectors, qi: np.ndarray, sj: np.ndarray) -> None:
        other = self.q.ids[qi] != s.ids[sj]
        qi, sj = qi[other], sj[other]
        if not len(qi):
            return
        total, some = np.zeros(len(qi)), np.zeros(len(qi), bool)
        plain = self.q.has is None and s.has is None
        with np.errstate(invalid="ignore", over="ignore"):
            for c in range(self.q.dims):
                off = self.q.x[c][qi] - s.x[c][sj]
                off *= off
                if not plain:
                    both = (True if self.q.has is None else self.q.has[c][qi]) & (True if s.has is None else s.has[c][sj])
                    off, some = np.where(both, off, 0), some | both
                total += off
        kind = np.where(np.isnan(total), _NAN, 0).astype(np.int8)
        if not plain or not self.q.dims:
            kind[~some] = _NULL
        d = np.where(kind == 0, np.sqrt(np.where(kind == 0, total, 0)), 0)
        own = np.unique(qi)
        rows = np.concatenate([np.repeat(own, self.k), qi])
        kind, d, j = (np.concatenate([old[own].ravel(), new]) for old, new in ((self.kind, kind), (self.d, d), (self.j, s.ids[sj])))
        order = np.lexsort((j, d, kind, rows))
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, np.diff(rows) != 0])
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = rank < self.k
        at, order = (rows[keep], rank[keep]), order[keep]
        self.kind[at], self.d[at], self.j[at] = kind[order], d[order], j[order]

    def see(self, s: Vectors) -> None:
        dims = max(self.q.dims, s.dims)
        self.q, s = self.q.padded(dims), s.padded(dims).without_crowds(self.k)
        odd, even = np.flatnonzero(~s.even), np.flatnonzero(s.even)
        for part, others in ((np.flatnonzero(~self.q.even), np.arange(len(s.ids))), (np.flatnonzero(self.q.even), odd)):
            step = max(1, PAIRS // max(1, len(others)))
            for a in range(0, len(part) if len(others) else 0, step):
                own = part[a : a + step]
                self.put(s, np.repeat(own, len(others)), np.tile(others, len(own)))
        if not len(even) or not dims:
            return
        right = np.concatenate([s.x[:, even], s.square[None, even]]).astype(np.float32)
        ids, by_id = s.ids[even], np.argsort(s.ids[even], kind="stable")
        off = 4 * (dims + 8) * 2.0**-24
        own = np.flatnonzero(self.q.even)
        for a in range(0, len(own), QUERIES):
            at = own[a : a + QUERIES]
            left = np.concatenate([-2 * self.q.x[:, at], np.ones((1, len(at)))]).T.astype(np.float32)
            near = left @ right  # the square of the distance, less that of the query
            lo, hi = (np.searchsorted(ids[by_id], self.q.ids[at], side) for side in ("left", "right"))
            for r in np.flatnonzero(lo < hi):
                near[r, by_id[lo[r] : hi[r]]] = np.inf
            margin = off * (self.q.square[at] + s.square[even].max()) + 1e-37
            full = self.kind[at, -1] == 0
            most = np.where(full, self.d[at, -1] ** 2 - self.q.square[at] + margin, np.inf)
            if not full.all() and len(even) >= self.k:
                few = np.flatnonzero(~full)
                most[few] = np.partition(near[few], self.k - 1, axis=1)[:, self.k - 1] + 2 * margin[few]
            r, c = np.nonzero(near <= np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None])
            self.put(s, at[r], even[c])

    def rows(self) -> pa.RecordBatch:
        at = np.nonzero(self.kind != _NONE)
        kind = self.kind[at]
        d = pa.array(np.where(kind == _NAN, np.nan, self.d[at]), mask=kind == _NULL)
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[at[0]]), pa.array(self.j[at]), d], ["i", "j", "d"])


def search(queries: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """(i, j, d): the k nearest of each query (i, q) among the rows (j, s) of all batches, whose ids are others."""
    found, step = Nearest(Vectors(queries.column("i"), queries.column("q")), k), FIRST
    for batch in batches:
        a = 0
        while a < batch.num_rows:
            part = batch.slice(a, step)
            found.see(Vectors(part.column("j"), part.column("s")))
            a, step = a + step, min(2 * step, ROWS)
    return found.rows()
