"""Language ID by bit-sliced Bloom filters of byte n-grams.

A filter slot holds one bit per language, so that one lookup of an n-gram (the AND of its slots) gives the set of all
languages that contain it. A text's n-grams are looked up, the bits are counted per language, and each count is corrected
for the false positives that the language's fill makes likely; the language with the largest corrected share wins.

n-grams are 3 and 5 bytes of the text with A-Z in lower case and everything else in ASCII but letters as a space, counted
with repeats. A language contains an n-gram if, per n-gram of training text, it is at least a fifth as frequent there
as where it is most frequent: a stray foreign passage or a wrong label in the training text adds nothing.

Training reads a sample of at most SAMPLE_DOCS labelled documents (about, drawn by a hash of the id); everything else,
the n-gram counts of that sample included, runs as Spark jobs. All n-grams that a language contains are filed, and the
number of slots follows from the language that has the most.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing could be learned; a text
too short for an n-gram, or whose n-grams no language contains, gets the most frequent language with score 0; ties go to
the alphabetically first language. Repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import _LOWER, bytes_of, mix, rolling, slices

SAMPLE_DOCS = 6000
SIZES = (3, 5)
#: An n-gram sets PROBES slots; there are SLOTS or more for each n-gram of a language, and 2**LEAST_BITS at least.
PROBES, SLOTS, LEAST_BITS = 2, 8, 16
LEAST_SHARE, LEAST_COUNT = 0.2, 2
_FOLD = _LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashes of all n-grams and how many each text has, in order."""
    data, offsets = bytes_of(texts)
    data = _FOLD[data].astype(np.uint64)
    for n in SIZES:
        h = rolling(data + np.uint64(n << 8), n)
        counts = np.maximum(np.diff(offsets) - (n - 1), 0)
        at = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        yield h[at], counts


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for p in range(PROBES):
        yield (h >> np.uint64(p * 32)) & np.uint64((1 << bits) - 1)


class Filters:
    """One bit-sliced filter for up to 64 languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, of: np.ndarray):
        """grams[i] is in language of[i]."""
        self.langs = langs
        most = int(np.bincount(of).max()) if len(of) else 0
        self.bits = min(32, max(LEAST_BITS, (SLOTS * most - 1).bit_length() if most else 0))
        self.slots = np.zeros(1 << self.bits, next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(langs) <= bits))
        for slot in _probes(grams, self.bits):
            np.bitwise_or.at(self.slots, slot, np.left_shift(np.uint64(1), of.astype(np.uint64)).astype(self.slots.dtype))
        fill = np.array([((self.slots >> self.slots.dtype.type(i)) & self.slots.dtype.type(1)).mean() for i in range(len(langs))])
        self.false = fill**PROBES

    def shares(self, texts: pa.Array) -> np.ndarray:
        """A row per text: of its n-grams, the share that each language contains, corrected for false positives."""
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for h, counts in _ngrams(texts):
            bits = np.full(len(h), np.iinfo(self.slots.dtype).max, self.slots.dtype)
            for slot in _probes(h, self.bits):
                bits &= self.slots[slot]
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(self.langs)):
                have = np.concatenate([[0], np.cumsum((bits >> bits.dtype.type(i)) & bits.dtype.type(1), dtype=np.int64)])
                hits[:, i] += have[edges[1:]] - have[edges[:-1]]
            total += counts
        n = np.maximum(total, 1)[:, None]
        return np.clip((hits / n - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[Filters]:
    """Filters from (doc_id, text, lang) rows; rows without text or lang are left out. The most frequent language first."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    total = rows.count()
    share = min(1.0, sample_docs / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist())
            for h, counts in _ngrams(batch.column("text")):
                of = np.repeat(langs, counts)
                for lang in np.unique(langs):
                    g, n = np.unique(h[of == lang], return_counts=True)
                    kinds = (pa.string(), pa.int64(), pa.int64())
                    columns = ([str(lang)] * len(g), g.view(np.int64), n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "g", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    totals = {r[0]: r[1] for r in sample.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}
    if not totals:
        return []
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    weight = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, 1.0 / max(1, totals[k]))]), F.col("lang"))
    grams = counts.where(F.col("n") >= LEAST_COUNT).withColumn("f", F.col("n") * weight)
    # one row an n-gram: the languages that contain it, as numbers in `langs`
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)]), F.col("lang"))
    grams = grams.groupBy("g").agg(F.collect_list(F.struct("f", number.alias("i"))).alias("all"))
    share = LEAST_SHARE * F.array_max(F.transform("all", lambda x: x["f"]))
    grams = grams.select("g", F.transform(F.filter("all", lambda x: x["f"] >= share), lambda x: x["i"]).alias("in"))
    # the sample bounds what is gathered here
    table = grams.toArrow().combine_chunks()
    lists = table.column("in").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    of = lists.flatten().to_numpy().astype(np.int64)
    g = np.repeat(table.column("g").to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy()) if len(lists) else 0)
    out = []
    for start in range(0, len(langs), 64):
        own = (of >= start) & (of < start + 64)
        out.append(Filters(langs[start : start + 64], g[own], of[own] - start))
    out[0].default = langs[0]
    return out


def predict(docs: DataFrame, filters: list[Filters], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not filters:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = [x for f in filters for x in f.langs]
        order = sorted(range(len(names)), key=lambda i: names[i])
        for batch in slices(batches):
            s = np.concatenate([f.shares(batch.column("text")) for f in filters], axis=1)[:, order]
            best = s.argmax(axis=1)
            top = s[np.arange(len(s)), best]
            lang = [names[order[i]] if x > 0 else filters[0].default for i, x in zip(best, top)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(top), batch.column("letter")], ["doc_id", "lang_pred", "score", "letter"])

    rows = rows.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = rows.mapInArrow(run, rows.schema[0].simpleString().replace(":", " ", 1) + ", lang_pred string, score double, letter boolean")
    return out.select(
        "doc_id", F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score")
    )


def held_out(doc_id: Column) -> Column:
    """True for the fourth of the ids that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    filters = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
