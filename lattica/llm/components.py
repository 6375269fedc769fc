"""Connected components by alternating large-star and small-star steps, each a shuffle of edges.

The edges of a step are written to the shared folder, so that lineage stays short. Nothing is gathered on the driver
but one number a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return hung.select("e.*").where("a <> b").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether some id hangs on two others, or on one that hangs on another: then these different edges are no stars yet."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    ends = ends.select("e.*").groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.max(F.col("up") + F.col("down"))).first()[0] not in (None, 1)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id that an edge (a, b) of longs joins to another; component is the least id reached."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while _open(edges):
        edges = written(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
