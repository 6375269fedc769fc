"""Voxel and grid grouping, histograms, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cell, trunc_cell
from .ids import dense_ids, ranked

XYZ = ("x", "y", "z")


def with_cells(points: DataFrame, size: tuple[float, float, float], truncate: bool = False, dims=XYZ) -> DataFrame:
    """`points` with integer cells c<dim>."""
    f = trunc_cell if truncate else cell
    return points.select("*", *[f(F.col(d), s).alias(f"c{d}") for d, s in zip(dims, size)])


def grid_sampling(points: DataFrame, size: tuple[float, float, float], mean: list[str] = (), last: list[str] = (), vote: list[str] = (), dims=XYZ, keys: list[str] = ()) -> DataFrame:
    """One row per occupied voxel: cells, n, means of coordinates and of `mean`, `last` by the largest pid, and the most
    frequent value of each `vote` column (the smallest of equals). One shuffle; all sums are partial first."""
    cells = [*keys, *[f"c{d}" for d in dims]]
    rows = with_cells(points, size, dims=dims)
    out = rows.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c) for c in (*dims, *mean)],
        *[F.max_by(c, "pid").alias(c) for c in last],
    )
    for v in vote:
        out = out.join(majority(rows, cells, v), cells)
    return out


def histogram(points: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, n): the label histogram of each group in long form."""
    return points.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def majority(points: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label): each group's most frequent label, the smallest of equals. Counts are reduced, never sorted."""
    h = histogram(points, keys, label)
    return h.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label))


def histogram_array(hist: DataFrame, keys: list[str], label: str, bins: int) -> DataFrame:
    """(keys, hist): the long histogram as an array of `bins` counts."""
    counts = [F.sum(F.when(F.col(label) == b, F.col("n")).otherwise(0)).cast("long") for b in range(bins)]
    return hist.groupBy(*keys).agg(F.array(*counts).alias("hist"))


def histogram_to_atomic(hist: DataFrame, label: str) -> DataFrame:
    """Each row of a long histogram n times again, without n."""
    return hist.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i")).drop("_i", "n")


def split_histogram(hist: DataFrame, key: str, chunk: int) -> DataFrame:
    """`hist` (key, n) with a chunk number, so that chunks hold about `chunk` items in the order of the key."""
    out = ranked(hist, [], [key], "_rank", ("n",))
    return out.withColumn("chunk", (F.ceil(F.col("sum_n") / chunk) - 1).cast("long")).drop("_rank", "sum_n")


def xy_partition(points: DataFrame, grid: float, dims=("x", "y"), dense: bool = True) -> DataFrame:
    """`points` with `part`: a row-major grid id of truncated cells, shifted to begin at 0; dense ids on request."""
    rows = with_cells(points, (grid,) * len(dims), truncate=True, dims=dims)
    low = [F.min(f"c{d}").alias(f"lo{d}") for d in dims]
    high = [F.max(f"c{d}").alias(f"hi{d}") for d in dims]
    rows = rows.crossJoin(F.broadcast(rows.agg(*low, *high)))
    part = F.lit(0).cast("long")
    for d in dims:
        part = part * (F.col(f"hi{d}") - F.col(f"lo{d}") + 1) + F.col(f"c{d}") - F.col(f"lo{d}")
    rows = rows.withColumn("part", part).drop(*[f"{a}{d}" for d in dims for a in ("c", "lo", "hi")])
    return dense_ids(rows, ["part"], "_dense").withColumn("part", F.col("_dense")).drop("_dense") if dense else rows


def xyz_partition(points: DataFrame, grid: float, dense: bool = True) -> DataFrame:
    return xy_partition(points, grid, XYZ, dense)
