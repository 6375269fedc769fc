"""Near duplicates by MinHash and a multi-index Hamming join.

1. Each text becomes the set of its distinct shingles (k consecutive words; A-Z in lower case). Texts with the same set
   are one class, which one text of it, known by a hash of its row's id and text, stands for from here on.
2. The set's signature has 66 components of b = 16 bits, split into CHUNKS = 15 chunks of four or five. By the pigeonhole
   principle two signatures that differ in at most MAX_DIFFERENT = 2 * 15 - 1 components have a chunk that differs in at
   most one; so the allowed errors of a chunk are enumerated, i.e. each signature is filed under its chunks with each one
   component left out in turn, and every such pair meets in a bucket. That is the distance up to which pairs are confirmed.
   At a similarity of 0.8, all but about two in a million pairs of texts are that close, and more similar pairs are closer.
3. Small buckets are compared in full. In a crowded bucket a few classes are pivots: each is compared with every class
   there that isn't known to be connected with it. So a group of thousands of near copies costs a star, not all pairs. It
   is also counted how many of a class's shingles no other class of a crowded bucket has: these can't be in an
   intersection, which rules out most comparisons exactly, and the class with the smallest such part is the first pivot.
   Components are made once, after both rounds of pivots; between them a class counts as its pivot's.
   Where a crowded bucket still has two components or more, the classes outside the largest one (the query set) are
   compared with all of their group in blocks, by matrix products over bounded runs of shingles, and no pair is made but the links found.
4. A pair's signatures are compared first; then the link is confirmed on the full shingle sets, made again from the
   texts. A pivot's partners are dealt to groups of bounded size, so that no task gets a large group whole.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component; a
text of fewer than k words has the whole sequence as its one shingle. Each row is judged by its own text, whatever its
doc_id; rows that repeat an id and its text get the same answer. A component's name is its smallest id that isn't null, and
null if it has none; a row is kept if its id is that name, and where there is none, if its text is the one that stands for
the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_key, written
from .components import components
from .hashing import Words, mix, rolling, slices

COMPONENTS, CHUNKS = 66, 15
#: Signatures that differ in at most so many components are sure to meet; those further apart aren't confirmed.
MAX_DIFFERENT = 2 * CHUNKS - 1
#: Classes in a small bucket; pivots in a crowded one in the second round; classes in a block, on either side.
SMALL, PIVOTS, BLOCK = 8, 3, (64, 256)
#: Partners of a pivot that one group checks; shingles that a block's product takes at once.
PARTNERS, COLUMNS = 64, 8192

#: Where chunks begin, and the last ends.
CUTS = [i * COMPONENTS // CHUNKS for i in range(CHUNKS + 1)]

_A = mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, COMPONENTS + 1001, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    w = Words(texts, lower=True)
    h = rolling(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(mix(rolling(w.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COMPONENTS 16-bit values for each non-empty set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COMPONENTS), np.uint16)
    v = np.empty_like(x)
    for c in range(COMPONENTS):
        np.multiply(x, _A[c], out=v)
        v += _B[c]
        out[:, c] = mix(np.minimum.reduceat(v, at).astype(np.uint64)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, id, n, d1, d2, sig) of every row: a hash of its id and text, the set's size, a digest of it, and its signature
    (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, _signatures([sets[i] for i in full])):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s).sum() for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mix(s + np.uint64(1)).sum() for s in sets], np.uint64).view(np.int64)),
                    pa.array(sig, pa.binary()),
                ],
                ["doc_id", "id", "n", "d1", "d2", "sig"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(doc_id, text).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, id long, n long, d1 long, d2 long, sig binary")


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, id): each class under its chunks with one component left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, COMPONENTS).astype(np.uint64)
                ids, keys = part.column("id").to_numpy(), []
                for first, end in zip(CUTS, CUTS[1:]):
                    for out in range(first, end):
                        key = np.full(len(sig), out, np.uint64)
                        for c in range(first, end):
                            if c != out:
                                key = mix((key << np.uint64(16)) + sig[:, c] + np.uint64(1))
                        keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, len(keys)))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _different(a: str, b: str):
    """Boolean of Arrow-batched signatures: at most MAX_DIFFERENT components differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for c in (a, b))
                near = pa.array((x != y).sum(axis=1) <= MAX_DIFFERENT)
                yield batch.select(["a", "b"]).filter(near)

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least `percent` hundredths of their union in common."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = written(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("groups"))
    partners = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("g"))
    partners = partners.join(texts.withColumnRenamed("id", "b"), "b").select("a", "g", "b", "text")
    pivots = per.join(texts.withColumnRenamed("id", "a"), "a")
    pivots = pivots.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.lit(None).cast("long").alias("b"), "text")

    def check(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("b").is_null())
        rest = table.filter(table.column("b").is_valid())
        pivot, links = shingle_sets(own.column("text").slice(0, 1), k)[0], []
        for batch in slices(iter(rest.combine_chunks().to_batches())):
            for b, s in zip(batch.column("b").to_pylist(), shingle_sets(batch.column("text"), k)):
                both = len(np.intersect1d(pivot, s, assume_unique=True))
                if 100 * both >= percent * (len(pivot) + len(s) - both):
                    links.append(b)
        return pa.table({"a": pa.array([own.column("a")[0].as_py()] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return partners.union(pivots).groupBy("a", "g").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, id, n, component, kept) of every row; id is a hash of doc_id and text."""
    made = written(sketch(docs, k, doc_id, text))
    classes = made.where("n > 0").groupBy("d1", "d2", "n")
    classes = written(classes.agg(F.min("id").alias("id"), F.min("doc_id").alias("name"), F.first("sig").alias("sig")))
    texts = docs.select(text_key(doc_id, text).alias("id"), F.col(text).alias("text"))
    texts = texts.join(classes.select("id"), "id", "left_semi")
    links = _links(classes.select("id", "n", "sig"), texts, k, percent)
    of_class = classes.select("d1", "d2", "n", "name", F.col("id").alias("rep"))
    if links is not None:
        of_class = of_class.join(links.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        named = of_class.groupBy("component").agg(F.min("name").alias("least"))
        of_class = of_class.join(named, "component").select("d1", "d2", "n", F.col("least").alias("name"), (F.col("component") == F.col("rep")).alias("first"))
    else:
        of_class = of_class.select("d1", "d2", "n", "name", F.lit(True).alias("first"))
    out = made.select("doc_id", "id", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("n") == 0, True).otherwise(F.coalesce(F.col("doc_id") == F.col("name"), F.col("name").isNull() & F.col("first")))
    return out.select("doc_id", "id", "n", name.alias("component"), kept.alias("kept"))


def _own_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(id, own): how many shingles of a text no other of these texts has; without those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            ids = np.repeat(batch.column("id").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(ids)], ["h", "id"])

    once = texts.mapInArrow(run, "h long, id long").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    return once.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _links(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(id, component) of the classes that are linked with another, or None if there are none."""
    rows = _bucket_rows(classes)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", (F.col("c") > SMALL).alias("crowded"))
    rows = written(rows.join(shared, "key"))
    crowd = rows.where("crowded").select("id").distinct()
    own = _own_shingles(texts.join(crowd, "id", "left_semi"), k)
    sizes = written(classes.select("id", "n").join(own, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own")))
    rows = rows.join(sizes, "id").select("key", "id", "crowded", F.col("id").alias("comp"), "n", F.when(F.col("crowded"), F.col("n") - F.col("own")).otherwise(F.col("n")).alias("common"))
    # a class whose own shingles are too many for any partner leaves the bucket
    rows = written(rows.where(f"common * 100 >= {percent} * n"))
    fits = f"least(common, q.common) * {100 + percent} >= {percent} * (n + q.n)"
    edges = None
    for first in (True, False):
        # only buckets with two components or more; these sums are made before the shuffle
        rank = F.struct((1 - F.col("common") / F.col("n")).alias("part"), F.xxhash64("id").alias("h"), F.col("id").alias("id"))
        live = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(rank).alias("least"))
        live = rows.join(live.where("lo <> hi").select("key", "c", F.col("least.id").alias("least")), "key")
        # a hash of the id, so that the draw comes out the same if a task runs again, and alike in all buckets of a class
        u = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = F.col("id") == F.col("least") if first else (u * F.col("c") < PIVOTS) | ~F.col("crowded")
        rows = written(live.select(*rows.columns, drawn.alias("pivot"))).select(*rows.columns, "pivot")
        turn = rows.where("crowded") if first else rows
        pivots = turn.where("pivot").select("key", F.col("id").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"), F.col("common").alias("pcommon"))
        pairs = turn.join(pivots, "key").where("comp <> pc and (not pivot or id > p)").where(fits.replace("q.", "p"))
        pairs = pairs.select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
        rows = rows.drop("pivot")
        near = pairs.join(classes.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        near = near.join(classes.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        near = written(near.mapInArrow(_different("sa", "sb"), "a long, b long"))
        if near.isEmpty():
            continue
        found = written(_confirmed(near, texts, k, percent))
        if first:
            # between the rounds it is enough to know what a pivot holds together: links that are known only spare pairs
            rows = _renamed(rows, found.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("now")))
        edges = found if edges is None else edges.union(found)
    joined = None if edges is None or edges.isEmpty() else written(components(edges))
    crowded = rows.where("crowded")
    if joined is not None:
        crowded = _renamed(crowded, joined.withColumnRenamed("component", "now"))
    found = _by_blocks(crowded, texts, k, percent)
    if found is None or found.isEmpty():
        return joined
    # `found` links whole components, each known by its least class, so stars are all that has to be joined
    stars = found if joined is None else found.union(joined.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return written(components(stars))


def _renamed(rows: DataFrame, now: DataFrame) -> DataFrame:
    """`rows` with the components of `now` (id, now) where it has them."""
    return rows.join(now, "id", "left").withColumn("comp", F.coalesce("now", "comp")).select(*rows.columns)


def _by_blocks(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links (a, b) between components that share a bucket of `rows`, one at least for each two that are linked.

    `rows` may tell apart classes that are linked; then there is more to compare, and the links are the same.
    """
    per = rows.groupBy("key").agg(F.min("id").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    live = written(rows.join(per.select("key", "least"), "key").select("id", "comp", "least").distinct())
    if live.isEmpty():
        return None
    # buckets that share a class of theirs are one group where they meet at once; two classes of a bucket always have one in common
    low = live.groupBy("id").agg(F.min("least").alias("low"))
    group = written(live.join(low, "id").groupBy("least").agg(F.min("low").alias("of")))
    members = written(live.join(group, "least").select("id", "comp", "of").distinct())
    sizes = members.groupBy("of", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("of").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.sum("c").alias("all"), F.max("c").alias("top"))
    blocks = most.select("of", "main", *[F.ceil(x / size).cast("long").alias(n) for n, x, size in (("nq", F.col("all") - F.col("top"), BLOCK[0]), ("na", F.col("all"), BLOCK[1]))])
    members = members.join(blocks, "of")
    spot = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = members.where("comp <> main").select("of", "id", "comp", spot("nq", 1).alias("q"), upto("na").alias("m"), F.lit(True).alias("asks"))
    others = members.select("of", "id", "comp", upto("nq").alias("q"), spot("na", 2).alias("m"), F.lit(False).alias("asks"))

    def check(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        comp = table.column("comp").to_numpy()
        sets = []
        for batch in slices(iter(table.select(["text"]).combine_chunks().to_batches())):
            sets += shingle_sets(batch.column("text"), k)
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), size)
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[col] > 1
        used, col = np.unique(col[shared], return_inverse=True)
        of, order = of[shared], np.argsort(col, kind="stable")
        both = np.zeros((asks.sum(), (~asks).sum()), np.int64)
        for a in range(0, len(used), COLUMNS):
            own = order[np.searchsorted(col, a, sorter=order) : np.searchsorted(col, a + COLUMNS, sorter=order)]
            matrix = np.zeros((len(sets), COLUMNS), np.float32)
            matrix[of[own], col[own] - a] = 1
            both += (matrix[asks] @ matrix[~asks].T).astype(np.int64)
        union = size[asks][:, None] + size[~asks][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (comp[asks][:, None] != comp[~asks][None, :]))
        links = np.unique(np.stack([comp[asks][i], comp[~asks][j]], axis=1), axis=0)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    each = asked.union(others).join(texts, "id")
    return written(each.groupBy("of", "q", "m").applyInArrow(check, "a long, b long"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with the columns it came with; rows that repeat its id and text stay as well."""
    (gone,) = fresh(docs, "gone")
    dropped = near_duplicates(docs, k, percent, doc_id, text).where("not kept").select(F.col("id").alias(gone))
    return docs.join(dropped, text_key(doc_id, text) == F.col(gone), "left_anti")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; 4-word shingles, similarity 0.8 or more."""
    out = near_duplicates(docs, k=4)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")
