"""Near duplicates by SimHash: fingerprints of 64 bits, linked where few bits differ.

1. A text's fingerprint has a bit where over half of its shingles' XXH64 hashes (seed 42) have it. Rows with one
   fingerprint are one class from here on, so a group of copies of any size is one row.
2. Segment-popcount embedding: a fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan
   distance of two count vectors is never more than the number of bits that differ (their Hamming distance).
3. Grid range-join: of the two halves of a count vector, 16 counts each, two vectors within a distance of 4 or 5 have one
   within 2. A half is a cell of a grid of width 1; each class is filed under its own cell and all cells within 1 of it, so
   that any two halves within 2 meet in the cell between them. No such pair is missed.
4. In a cell the pairs are verified exactly, by the bits that differ. A cell gives one row for each linked class (the least
   class of its group there), not one for each pair. Cells of over CROWD classes are split into blocks, each pair of which
   is a group of its own, so that no task takes a whole crowded cell.
5. Groups are joined by stars over all links.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a null text and one without words have fingerprint
zero and are linked like any other; a text of fewer than k words has the whole sequence as its one shingle; repeated
shingles count each time. A component's name is its smallest id that isn't null, and null if it has none. Each row is judged
by its own text, whatever its id, and rows that repeat come out alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .components import components
from .hashing import _IS_SPACE, _LOWER, Words, slices

#: Shingles hashed at once; rows of a cell compared with the rest at once.
RUN, ROWS = 65_536, 256
#: Runs of a cell that are compared by shifts of the whole batch; classes in a cell beyond which it is split.
SMALL, CROWD = 64, 2048


def fingerprints_of(texts: pa.Array, k: int) -> np.ndarray:
    """One unsigned fingerprint for each text."""
    w = Words(texts, lower=True)
    size = w.ends - w.starts
    # all words, one space after each, so that shingles are slices
    start = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    letters = _LOWER[w.data[~_IS_SPACE[w.data]]]
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    data = joined.tobytes()
    words = w.counts()
    m = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(m)), m)
    first = w.first[:-1][doc] + np.arange(len(doc)) - (np.cumsum(m) - m)[doc]
    last = first + np.minimum(words, k)[doc] - 1
    ones = np.zeros((len(m), 64), np.int64)
    for a in range(0, len(doc), RUN):
        own = doc[a : a + RUN]
        spans = zip(start[first[a : a + RUN]].tolist(), (start + size)[last[a : a + RUN]].tolist())
        digests = b"".join([xxhash.xxh64_digest(data[x:y], 42) for x, y in spans])  # the highest bit first
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > m[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = fingerprints_of(batch.column("text"), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments of two bits, two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _filed(classes: DataFrame, radius: int) -> DataFrame:
    """(cell, fp): each class under the cells within `radius` (0 or 1) of either half of its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(a, 4096).to_numpy()
                counts = segment_counts(fp.view(np.uint64)).view(np.int64)
                cells, owners = [], []
                for half in (0, 1):
                    own = ((counts >> (32 * half)) & 0xFFFFFFFF) | (half << 32)
                    cells.append(own)
                    owners.append(fp)
                    for shift in range(0, 32 * radius, 2):
                        count = (own >> shift) & 3
                        for step, free in ((1, count < 2), (-1, count > 0)):
                            cells.append(own[free] + (step << shift))
                            owners.append(fp[free])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(owners))], ["cell", "fp"])

    return classes.mapInArrow(run, "cell long, fp long")


def _least(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member of each node's group, by links between nodes a and b."""
    label = np.arange(n) if label is None else label
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _groups(cell: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For rows sorted by cell: the place of the least row that links within its cell lead to."""
    n = len(fp)
    starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    sizes = np.diff(starts, append=n)
    pairs, at, shift = [], np.flatnonzero(np.repeat(sizes <= SMALL, sizes)), 0
    while len(at):
        shift += 1
        at = at[at + shift < n]
        at = at[cell[at] == cell[at + shift]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= distance]
        pairs.append((near, near + shift))
    label = _least(n, *(np.concatenate(x) for x in zip(*pairs))) if pairs else np.arange(n)
    for first, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own, inside = fp[first : first + size], np.arange(size)
        for a in range(0, size, ROWS):
            x, y = np.nonzero(np.bitwise_count(own[a : a + ROWS, None] ^ own[None, :]) <= distance)
            inside = _least(size, x + a, y, inside)
        label[first : first + size] = first + inside
    return label


def _linked(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b) of rows that come sorted by cell: each class with the least one of its group in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(stop: int) -> pa.RecordBatch:
            to = _groups(cell[:stop], fp[:stop], distance)
            hung = np.flatnonzero(to != np.arange(stop))
            pairs = np.unique(np.stack([fp[hung], fp[to[hung]]]).view(np.int64), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                cell = np.concatenate([cell, batch.column("cell").to_numpy()])
                fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
                stop = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
                if stop:
                    yield links(stop)
                    cell, fp = cell[stop:], fp[stop:]
        if len(cell):
            yield links(len(cell))

    return rows.select("cell", "fp").mapInArrow(run, "a long, b long")


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) of different fingerprints, column `fp` of `classes`, that differ in at most `distance` bits, in as many rows as
    connect them: following (a, b) leads from a fingerprint to just those that its links lead to."""
    if not 0 <= distance <= 5:
        raise ValueError("two halves of a distance over 5 need not meet in a cell")
    rows = _filed(classes.select("fp"), min(1, distance // 2))
    crowded = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD))
    calm = rows.join(crowded.select("cell"), "cell", "left_anti").repartition("cell").sortWithinPartitions("cell")
    found = _linked(calm, distance)
    if not crowded.isEmpty():
        blocks = F.ceil(F.col("c") * 2 / CROWD).cast("long")
        split = rows.join(crowded, "cell").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        split = split.select(pair.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
        found = found.union(_linked(split, distance))
    return found


def near_duplicates(docs: DataFrame, k: int = 5, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component) of every row."""
    made = written(fingerprints(docs, k, doc_id, text))
    classes = written(made.groupBy("fp").agg(F.min("doc_id").alias("name")))
    found = written(links(classes, distance))
    joined = components(found)
    dropped(found)
    of_class = classes.join(joined.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = of_class.groupBy("component").agg(F.min("name").alias("least"))
    of_class = of_class.join(names, "component").select("fp", F.col("least").alias("component"))
    return made.join(of_class, "fp").select("doc_id", "fp", "component")


def simhash_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint of its 4-word shingles in 16 hex digits, component_id (4 bits or fewer)."""
    out = near_duplicates(docs, k=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
