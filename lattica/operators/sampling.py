"""Sampling, tiling and crops. Random choices follow a hash of id and seed, so they come out the same when tasks run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import distance2
from ..storage import written
from .ids import lower_median, ranked
from .neighbors import nearest, within_radius


def _uniform(*cols, seed: int = 0) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))


def sample_size(n: Column, n_max: int, n_min: int) -> Column:
    """How many of a group of n to keep: floor(n_max tanh(n / n_max)), or round(sqrt(n)) if n_max <= 0, within n_min..n."""
    soft = F.floor(n_max * F.tanh(n / n_max)) if n_max > 0 else F.rint(F.sqrt(n)).cast("long")
    return F.least(n, F.greatest(soft, F.lit(n_min)))


def sparse_sample(rows: DataFrame, group: str, n_max: int = 32, n_min: int = 1, id: str = "pid", seed: int = 0) -> DataFrame:
    """A sample without replacement of each group.

    With n_max > 0 each task first keeps no more of a group than a sample can have; else groups are ranked in parts.
    """
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), id))
    if n_max > 0:
        w = Window.partitionBy(group).orderBy("_h", id)
        out = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(n_max, n_min))
    else:
        out = ranked(rows, [group], ["_h", id], "_r")
    out = out.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    return out.where(F.col("_r") <= sample_size(F.col("_n"), n_max, n_min)).drop("_r", "_n", "_g", "_h")


def sample_edges(edges: DataFrame, n_min: int = 16, n_max: int = 32, seed: int = 0) -> DataFrame:
    """At most a sample of each source's edges."""
    return sparse_sample(edges.withColumn("_t", F.col("t")), "s", n_max, n_min, "_t", seed).drop("_t")


def weighted_sample(rows: DataFrame, k: int, weight: Column, id: str = "id", seed: int = 0) -> DataFrame:
    """k rows without replacement, likelier with a larger weight: the smallest -ln(u) / weight."""
    return rows.orderBy(-F.log(_uniform(id, seed=seed)) / weight, id).limit(k)


def segment_weights(nodes: DataFrame, by_size: bool, by_class: bool) -> DataFrame:
    """`nodes` (node_size, y) with `weight`: 1, plus a share for size^0.333, plus a share for rare classes."""
    w = F.lit(1.0)
    if by_size:
        total = F.broadcast(nodes.agg(F.sum(F.pow("node_size", F.lit(0.333))).alias("_size")))
        nodes = nodes.crossJoin(total)
        w = w + F.pow("node_size", F.lit(0.333)) / F.col("_size")
    if by_class:
        counts = nodes.groupBy("y").agg(F.count(F.lit(1)).alias("_count"))
        counts = counts.crossJoin(F.broadcast(counts.agg(F.sum(1 / F.sqrt("_count")).alias("_rare"))))
        nodes = nodes.join(F.broadcast(counts), "y")
        w = w + 1 / F.sqrt("_count") / F.col("_rare")
    return nodes.withColumn("weight", w).drop("_size", "_count", "_rare")


def sample_segments(nodes: DataFrame, ratio: float, by_size: bool = False, by_class: bool = False, seed: int = 0) -> DataFrame:
    """`nodes` without a share `ratio` of them."""
    n = nodes.count()
    return weighted_sample(segment_weights(nodes, by_size, by_class), n - int(n * ratio), F.col("weight"), seed=seed).drop("weight")


def restrict_size(nodes: DataFrame, edges: DataFrame, num_nodes: int = 0, num_edges: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """At most num_nodes nodes and, of the edges between them, at most num_edges."""
    from .hierarchy import select_edges

    if num_nodes > 0:
        nodes = written(nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(num_nodes))
        edges = select_edges(edges, nodes)
    if num_edges > 0:
        edges = edges.orderBy(F.xxhash64(F.lit(seed), "s", "t"), "s", "t").limit(num_edges)
    return nodes, edges


def xy_tile(points: DataFrame, x: int, y: int, tiling: int) -> DataFrame:
    """The points of tile (x, y) of the bounding box cut into tiling^2; those at the very maximum are in none,
    nor are any if the box has no extent."""
    box = F.broadcast(points.agg(*[f(d).alias(f"_{n}{d}") for d in "xy" for n, f in (("lo", F.min), ("hi", F.max))]))
    at = {d: F.floor(F.try_divide(F.col(d) - F.col(f"_lo{d}"), F.col(f"_hi{d}") - F.col(f"_lo{d}")) * tiling) for d in "xy"}
    return points.crossJoin(box).where((at["x"] == x) & (at["y"] == y)).select(*points.columns)


def recursive_tile(points: DataFrame, path: int, steps: int) -> DataFrame:
    """The part that `path` names: at each step the points are halved at the lower median along their principal XY axis.

    The axis points to growing x (growing y, if it is straight); the first step is the highest bit of `path`.
    """
    for step in range(steps):
        c = points.agg(F.covar_pop("x", "x").alias("a"), F.covar_pop("x", "y").alias("b"), F.covar_pop("y", "y").alias("c"))
        half = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
        flip = F.when(F.cos(half) < 0, -1.0).otherwise(1.0)
        axis = F.broadcast(c.select((flip * F.cos(half)).alias("_u"), (flip * F.sin(half)).alias("_v")))
        rows = points.crossJoin(axis).withColumn("_along", F.col("x") * F.col("_u") + F.col("y") * F.col("_v"))
        middle = F.broadcast(lower_median(rows, "_along").withColumnRenamed("median", "_m"))
        upper = (path >> (steps - 1 - step)) & 1
        rows = rows.crossJoin(middle).where(F.col("_along") > F.col("_m") if upper else F.col("_along") <= F.col("_m"))
        points = written(rows.drop("_u", "_v", "_along", "_m"))
    return points


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id): the nodes that undirected edges reach from the seeds (id) in at most `hops` steps."""
    both = written(edges.select("s", "t").union(edges.select("t", "s")).distinct())
    seen = newest = written(seeds.select("id").distinct())
    for _ in range(hops):
        # only the newest nodes are followed, and each hop is written, so that the plan doesn't grow with the hops
        ahead = both.join(newest.withColumnRenamed("id", "s"), "s", "left_semi").select(F.col("t").alias("id")).distinct()
        newest = written(ahead.join(seen, "id", "left_anti"))
        seen = seen.union(newest)
    return seen


def radius_crop(points: DataFrame, seeds: DataFrame, r: float, k_max: int | None = None, cylinder: bool = False) -> DataFrame:
    """(i, j, d): for each seed the points within a sphere, or an upright cylinder, around it; at most the k_max nearest."""
    pairs = within_radius(seeds, points, r, ("x", "y") if cylinder else ("x", "y", "z"))
    return pairs if k_max is None else nearest(pairs, k_max).drop("rank")


def sort_along(points: DataFrame, group: str, direction: tuple[float, float, float]) -> DataFrame:
    """`points` with `place`, from 0 in each group, by the projection on a direction."""
    along = sum((F.col(d) * v for d, v in zip("yz", direction[1:])), F.col("x") * direction[0])
    out = ranked(points.withColumn("_along", along), [group], ["_along", "pid"], "place")
    return out.withColumn("place", F.col("place") - 1).drop("_along")


def balanced_sample(rows: DataFrame, label: str, ratio: float = 1.0, minority: int | None = None, id: str = "pid", seed: int = 0) -> DataFrame:
    """As many rows of each label as the rarest has; with `minority`, all of that and `ratio` times as many of the rest."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    if minority is None:
        cap = counts.agg(F.min("c").alias("_cap"))
        rule = F.col("_r") <= F.col("_cap")
    else:
        cap = counts.agg(F.coalesce(F.sum(F.when(F.col(label) == minority, F.col("c"))), F.lit(0)).alias("_cap"))
        rule = (F.col(label) == minority) | (F.col("_r") <= F.col("_cap") * ratio)
    rows = ranked(rows.withColumn("_h", F.xxhash64(F.lit(seed), id)), [label], ["_h", id], "_r")
    return rows.crossJoin(F.broadcast(cap)).where(rule).drop("_r", "_cap", "_h")


def ball(points: DataFrame, center: tuple[float, float, float], r: float) -> DataFrame:
    return points.where(distance2([F.col(d) for d in "xyz"], [F.lit(float(v)) for v in center]) <= r * r)
