"""Neighbour search as grid-bucket equi-joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import distance2
from ..storage import dropped, written
from . import vectors
from .graph import trimmed

XYZ = ("x", "y", "z")


def within_radius(query: DataFrame, search: DataFrame, r: float, dims=XYZ, keys: list[str] = (), qid: str = "pid", sid: str = "pid") -> DataFrame:
    """(i, j, d) and `keys`: all pairs of a query and a search point at most r apart.

    Cells have the side r, so a query's neighbours lie in 3^d cells. The search side is filed once and the queries are
    looked up in each of the cells: an equi-join on the cell, which Spark may split where a cell is crowded.
    """
    cells = [f"_c{d}" for d in dims]
    at = lambda df: [F.floor(F.col(d) / r).cast("long").alias(c) for d, c in zip(dims, cells)]
    s = search.select(*keys, F.col(sid).alias("j"), *[F.col(d).alias(f"_s{d}") for d in dims], *at(search))
    q = query.select(*keys, F.col(qid).alias("i"), *[F.col(d).alias(f"_q{d}") for d in dims], *at(query))
    for c in cells:
        q = q.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    pairs = q.join(s, [*keys, *cells])
    d2 = distance2([F.col(f"_q{d}") for d in dims], [F.col(f"_s{d}") for d in dims])
    return pairs.where(d2 <= r * r).select(*keys, "i", "j", F.sqrt(d2).alias("d"))


def pairs_within(points: DataFrame, r: float, dims=XYZ) -> DataFrame:
    """(i, j, d) as `within_radius` of points among themselves, but for pairs of one pid; with the cell of i as `_c<dim>`.

    Each pair is met once, from the one of its cells that is first: half as many cells are looked up. Spark sizes points that
    are looked up in many cells as if each were in one, and is told not to broadcast them.
    """
    cells = [f"_c{d}" for d in dims]
    at = [F.floor(F.col(d) / r).cast("long") for d in dims]
    s = points.select(F.col("pid").alias("j"), *[F.col(d).alias(f"_s{d}") for d in dims], *[c.alias(n) for c, n in zip(at, cells)])
    steps = [x for x in product((-1, 0, 1), repeat=len(dims)) if x >= (0,) * len(dims)]
    looked = F.explode(F.array(*[F.struct(*[(c + k).alias(n) for c, k, n in zip(at, x, cells)], F.lit(not any(x)).alias("_own")) for x in steps]))
    q = points.select(F.col("pid").alias("i"), *[F.col(d).alias(f"_q{d}") for d in dims], looked.alias("_at")).select("i", *[f"_q{d}" for d in dims], "_at.*")
    d2 = distance2([F.col(f"_q{d}") for d in dims], [F.col(f"_s{d}") for d in dims])
    met = q.join(s.hint("merge"), cells).where((d2 <= r * r) & (F.col("i") != F.col("j")) & (~F.col("_own") | (F.col("i") < F.col("j"))))
    there = [F.floor(F.col(f"_q{d}") / r).cast("long").alias(n) for d, n in zip(dims, cells)]
    ways = F.explode(F.array(F.struct("i", "j", *there), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *cells)))
    return met.select(F.sqrt(d2).alias("d"), ways.alias("_e")).select("_e.i", "_e.j", "d", *[f"_e.{n}" for n in cells])


def nearest(pairs: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """The k nearest of each i with their rank from 1; ties go to the smaller j."""
    w = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_last("d"), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(points: DataFrame, k: int, r: float, dims=XYZ, keys: list[str] = (), self_is_neighbor: bool = False) -> DataFrame:
    """(i, rank, j, d): each point's k nearest within r, by id never itself unless asked for."""
    if not keys and not self_is_neighbor:
        return nearest(pairs_within(points, r, dims).select("i", "j", "d"), k)
    pairs = within_radius(points, points, r, dims, keys)
    return nearest(pairs if self_is_neighbor else pairs.where("i <> j"), k, keys)


def knn_between(query: DataFrame, search: DataFrame, k: int, r: float, dims=XYZ, keys: list[str] = (), qid: str = "pid", sid: str = "pid") -> DataFrame:
    return nearest(within_radius(query, search, r, dims, keys, qid, sid), k, keys)


#: Parts of the search side of `knn_vectors` at most, and rows of a part before there are so many.
PARTS, PART_ROWS = 32, 20_000


def knn_vectors(query: DataFrame, search: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """(i, rank, j, d): exact k nearest of a set of query vectors (vec_id long, embedding) among all others; ties to the smaller j.

    The queries are taken in blocks of about `block`, each broadcast in a pass over the search side: more queries mean more
    passes, not more memory. A task takes its rows as they come (`vectors`), and keeps k candidates a query before anything is
    shuffled. As in SQL, elements that one of two vectors lacks aren't counted, and rows without a distance come last.
    """
    spark = query.sparkSession
    own = written(query.select(F.col("vec_id").cast("long").alias("i"), F.col("embedding").alias("q")).where("i is not null"))
    rows = search.select(F.col("vec_id").cast("long").alias("j"), F.col("embedding").alias("s")).where("j is not null")
    blocks = max(1, -(-own.count() // block))
    rows = rows.repartition(min(PARTS, max(1, -(-rows.count() // PART_ROWS))), "j")

    def pairs(b: int) -> DataFrame:
        held = spark.sparkContext.broadcast(own.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield vectors.search(held.value, batches, k)

        return rows.mapInArrow(run, "i long, j long, d double")

    out = reduce(DataFrame.union, [pairs(b) for b in range(blocks)])
    dropped(own)
    return nearest(out, k)


def oversampled(neighbors: DataFrame, k: int) -> DataFrame:
    """Fills each i's missing ranks up to k by going round the neighbours it has."""
    have = neighbors.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d"))).alias("have"))
    rows = have.select("i", "have", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    pick = F.get("have", F.pmod(F.col("rank") - 1, F.size("have")))
    return rows.select("i", "rank", pick["j"].alias("j"), pick["d"].alias("d"))


def dense_neighbors(neighbors: DataFrame) -> DataFrame:
    """(i, js, ds): neighbours as arrays, in the order of their rank."""
    rows = neighbors.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d"))).alias("_a"))
    return rows.select("i", F.transform("_a", lambda x: x["j"]).alias("js"), F.transform("_a", lambda x: x["d"]).alias("ds"))


def inliers(points: DataFrame, k_min: int, r: float, dims=XYZ, recursive: bool = False, rounds: int | None = None) -> DataFrame:
    """The points with at least k_min others within r; if recursive, among the points that remain, until none leaves.

    Without a bound on the rounds, close pairs are found once, and are then all that is looked at (`_peeled`).
    """
    if recursive and rounds is None:
        return points.join(_peeled(pairs_within(points, r, dims).drop("d"), k_min, [f"_c{d}" for d in dims]), "pid", "left_semi")
    k, before = 0, None
    while rounds is None or k < rounds:
        n = within_radius(points, points, r, dims).where("i <> j").groupBy("i").agg(F.count(F.lit(1)).alias("_n"))
        kept = points.join(n.where(F.col("_n") >= k_min).select(F.col("i").alias("pid")), "pid", "left_semi")
        if not recursive:
            return kept
        before = points.count() if before is None else before
        points = written(kept)
        now = points.count()
        if now == before:
            break
        k, before = k + 1, now
    return points


def _peeled(pairs: DataFrame, k_min: int, near: list[str]) -> DataFrame:
    """(pid): what is left of the graph of `pairs` (i, j, both ways around) when all that have less than k_min leave, again and again.

    Pairs are dealt out by place (`near`, then i), in parts of about the same size. A task lets the points of its part leave
    until none does, taking those of other parts as staying; then the pairs go of which the other point has left its part.
    Points leave in the end whatever the order, so that rounds follow how often a line crosses parts and not its length.
    """
    columns = ["i", "j", *near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            part = pa.Table.from_batches(held)
            yield from part.filter(pa.array(_stay(part.column("i"), part.column("j"), k_min))).to_batches(10_000)

    now = written(pairs.select(*columns))
    while True:
        inner = written(now.repartitionByRange(*near, "i").mapInArrow(run, now.schema))
        stay = inner.select(F.col("i").alias("j")).distinct()
        old, now = now, written(inner.join(stay.hint("merge"), "j", "left_semi").select(*columns))
        ended = inner.count() == now.count()
        dropped(old, inner)
        if ended:
            break
    return now.select(F.col("i").alias("pid")).distinct()


def _stay(i: pa.ChunkedArray, j: pa.ChunkedArray, k_min: int) -> np.ndarray:
    """Which pairs (i, j) of a part stay; any j that is no i stays."""
    ids = pc.unique(i)
    a = pc.index_in(i, ids).to_numpy()
    b = pc.index_in(j, ids).fill_null(len(ids)).to_numpy()
    n = np.bincount(a, minlength=len(ids) + 1)
    n[-1] = k_min
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], np.arange(len(ids) + 1))
    stays = np.ones(len(ids) + 1, bool)
    leave = np.flatnonzero(n < k_min)
    while len(leave):
        stays[leave] = False
        size = first[leave + 1] - first[leave]
        hit = a[order[np.repeat(first[leave] - np.cumsum(size) + size, size) + np.arange(size.sum())]]
        np.subtract.at(n, hit, 1)
        hit = np.unique(hit)
        leave = hit[stays[hit] & (n[hit] < k_min)]
    return stays[a] & stays[b]


def outliers(points: DataFrame, k_min: int, r: float, dims=XYZ, recursive: bool = False, rounds: int | None = None) -> DataFrame:
    return points.join(inliers(points, k_min, r, dims, recursive, rounds).select("pid"), "pid", "left_anti")


def nearest_pairs(points: DataFrame, edges: DataFrame, group: str, dims=XYZ, cycles: int = 3) -> DataFrame:
    """(s, t, i, j, d): for each pair of groups in `edges` two points i of s and j of t that lie close to each other.

    From the centre of s to the nearest point of t, from there to the nearest point of s, and so on for some cycles: the
    cost follows the points of the groups, not their pairs. Ties go to the smaller id.
    """
    centre = points.groupBy(F.col(group).alias("s")).agg(*[F.avg(d).alias(f"_a{d}") for d in dims])
    at = edges.select("s", "t").distinct().join(centre, "s")

    def step(at: DataFrame, end: str) -> DataFrame:
        own = points.select(F.col(group).alias(end), "pid", *[F.col(d).alias(f"_p{d}") for d in dims])
        d2 = distance2([F.col(f"_a{d}") for d in dims], [F.col(f"_p{d}") for d in dims])
        best = at.join(own, end).groupBy("s", "t").agg(F.min(F.struct(d2.alias("d2"), "pid", *[f"_p{d}" for d in dims])).alias("b"))
        return best.select("s", "t", F.col("b.pid").alias("p"), F.sqrt("b.d2").alias("d"), *[F.col(f"b._p{d}").alias(f"_a{d}") for d in dims])

    for _ in range(cycles):
        j = written(step(at, "t"))
        at = written(step(j.drop("p", "d"), "s"))
    return at.select("s", "t", F.col("p").alias("i"), "d").join(j.select("s", "t", F.col("p").alias("j")), ["s", "t"]).select("s", "t", "i", "j", "d")


def edge_wise_points(points: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(s, t, side, pid): each edge with every point of its two groups."""
    parts = [edges.select("s", "t").join(points.select(F.col(group).alias(e), "pid"), e).select("s", "t", F.lit(e).alias("side"), "pid") for e in ("s", "t")]
    return parts[0].union(parts[1])


def cluster_radius_graph(points: DataFrame, group: str, gap: float, dims=XYZ, k_max: int | None = None) -> DataFrame:
    """(s, t, d): groups s < t with two points at most `gap` apart, and the least such distance.

    The points themselves are matched on a grid of the side `gap`, so the cost follows the number of close pairs of
    points and not that of pairs of groups. With k_max, only each group's nearest k_max are kept (from either side).
    """
    pairs = within_radius(points, points, gap, dims)
    own = points.select(F.col("pid").alias("i"), F.col(group).alias("s"))
    pairs = pairs.join(own, "i").join(own.withColumnsRenamed({"i": "j", "s": "t"}), "j").where("s < t")
    out = pairs.groupBy("s", "t").agg(F.min("d").alias("d"))
    if k_max is None:
        return out
    both = out.union(out.select(F.col("t").alias("s"), F.col("s").alias("t"), "d"))
    w = Window.partitionBy("s").orderBy("d", "t")
    return trimmed(both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k_max).drop("_r"), {"d": "min"})


def interpolate_unseen(nodes: DataFrame, seen: DataFrame, values: list[str], r: float, dims=XYZ) -> DataFrame:
    """`nodes` with `values` of their own where seen, else those of the nearest seen node within r, else null."""
    missing = nodes.join(seen.select("pid"), "pid", "left_anti")
    near = knn_between(missing, nodes.join(seen.select("pid"), "pid", "left_semi"), 1, r, dims).select(F.col("i").alias("pid"), "j")
    source = near.unionByName(seen.select("pid", F.col("pid").alias("j")))
    got = source.join(seen.select(F.col("pid").alias("j"), *values), "j").drop("j")
    return nodes.join(got, "pid", "left")
