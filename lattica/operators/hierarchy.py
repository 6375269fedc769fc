"""Nested partitions: levels of nodes, each pointing to its parent by super_index."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import dense_ids
from .voxels import with_cells


def levels_of(level: int | str, count: int, start: int = 0) -> list[int]:
    """Levels that a selector names: a number, `all`, `2+` (from 2 on) or `2-` (below 2)."""
    every = list(range(start, start + count))
    if isinstance(level, int):
        return [level]
    if level == "all":
        return every
    at = int(level[:-1])
    return [i for i in every if (i >= at if level[-1] == "+" else i < at)]


@dataclass(frozen=True)
class Hierarchy:
    """nodes[i]: id, super_index (but for the top), features; edges[i]: s, t, features; overlaps[i]: cluster, obj, cnt, y."""

    nodes: dict[int, DataFrame]
    edges: dict[int, DataFrame] = field(default_factory=dict)
    overlaps: dict[int, DataFrame] = field(default_factory=dict)

    def map_nodes(self, f, level: int | str = "all") -> "Hierarchy":
        chosen = levels_of(level, len(self.nodes), min(self.nodes))
        return replace(self, nodes={i: f(df) if i in chosen else df for i, df in self.nodes.items()})

    @property
    def level_range(self) -> list[int]:
        return sorted(self.nodes)

    def super_index(self, low: int, high: int) -> DataFrame:
        """(id, super_index): the ancestor at `high` of each node at `low`."""
        out = self.nodes[low].select("id", "super_index")
        for i in range(low + 1, high):
            up = self.nodes[i].select(F.col("id").alias("super_index"), F.col("super_index").alias("_up"))
            out = out.join(up, "super_index").select("id", F.col("_up").alias("super_index"))
        return out

    def sub_size(self, low: int, high: int) -> DataFrame:
        """(id, node_size): how many nodes at `low` each node at `high` holds."""
        return self.super_index(low, high).groupBy(F.col("super_index").alias("id")).agg(F.count(F.lit(1)).alias("node_size"))

    def level_sizes(self) -> DataFrame:
        """(level, n) of each level."""
        return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("level"), "n") for i, df in sorted(self.nodes.items())])

    def select(self, level: int, ids: DataFrame) -> "Hierarchy":
        """Keeps the nodes `ids` (id) at a level, their descendants, and the ancestors that still have children.

        Edges stay where both ends do. Ids are kept as they are: keys, not positions.
        """
        nodes = {level: self.nodes[level].join(ids.select("id").distinct(), "id", "left_semi")}
        for i in range(level - 1, min(self.nodes) - 1, -1):
            up = nodes[i + 1].select(F.col("id").alias("super_index"))
            nodes[i] = self.nodes[i].join(up, "super_index", "left_semi")
        for i in range(level + 1, max(self.nodes) + 1):
            down = nodes[i - 1].select(F.col("super_index").alias("id")).distinct()
            nodes[i] = self.nodes[i].join(down, "id", "left_semi")
        edges = {i: select_edges(e, nodes[i]) for i, e in self.edges.items()}
        overlaps = {i: o.join(nodes[i].select(F.col("id").alias("cluster")), "cluster", "left_semi") for i, o in self.overlaps.items()}
        return Hierarchy(nodes, edges, overlaps)

    def select_by_key(self, level: int, key: str, negation: bool = False) -> "Hierarchy":
        keep = ~F.col(key) if negation else F.col(key)
        return self.select(level, self.nodes[level].where(keep))

    def propagate_instances(self) -> "Hierarchy":
        """Overlaps of every level from those of the lowest."""
        low = min(self.nodes)
        out = {low: self.overlaps[low]}
        for i in range(low + 1, max(self.nodes) + 1):
            from .instances import merge_overlaps

            out[i] = merge_overlaps(out[i - 1], self.nodes[i - 1].select(F.col("id").alias("cluster"), "super_index"))
        return replace(self, overlaps=out)

    def save(self, path: str, mode: str = "error") -> None:
        """One Parquet dataset for nodes and one for edges, partitioned by level."""
        for kind in ("nodes", "edges", "overlaps"):
            tables = getattr(self, kind)
            for i, df in tables.items():
                df.write.mode(mode).parquet(f"{path}/{kind}/level={i}")

    @staticmethod
    def load(spark, path: str, levels: list[int], columns: list[str] | None = None, kinds=("nodes", "edges")) -> "Hierarchy":
        """The named levels only, and of the nodes only the named columns: both reach the scan."""
        out: dict[str, dict[int, DataFrame]] = {k: {} for k in ("nodes", "edges", "overlaps")}
        for kind in kinds:
            for i in levels:
                df = spark.read.parquet(f"{path}/{kind}/level={i}")
                out[kind][i] = df.select(*columns) if columns and kind == "nodes" else df
        return Hierarchy(**out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among `nodes`."""
    for end in ("s", "t"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def reindexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under dense ids 0..n-1, in the order of the old ones; edges with an end elsewhere are dropped."""
    nodes = dense_ids(nodes, ["id"], "new_id")
    ids = nodes.select("id", "new_id")
    for end in ("s", "t"):
        edges = edges.join(ids.withColumnsRenamed({"id": end, "new_id": f"new_{end}"}), end)
    return nodes, edges


def grid_hierarchy(points: DataFrame, sizes: list[float], dims=("x", "y")) -> Hierarchy:
    """Levels by truncated grid cells of growing size. A parent's position is the unweighted mean of its children's."""
    nodes, level = points.withColumn("id", F.col("pid").cast("long")), {}
    for i, size in enumerate(sizes):
        cells = [f"c{d}" for d in dims]
        rows = dense_ids(with_cells(nodes, (size,) * len(dims), truncate=True, dims=dims), cells, "super_index").drop(*cells)
        level[i] = rows
        nodes = rows.groupBy(F.col("super_index").alias("id")).agg(*[F.avg(d).alias(d) for d in ("x", "y", "z")], F.count(F.lit(1)).alias("n_children"))
    level[len(sizes)] = nodes
    return Hierarchy(level)


def expand_predictions(preds: DataFrame, *memberships: DataFrame, value: str = "pred") -> DataFrame:
    """(id, value): predictions (id, value) of segments carried down to their members; memberships: id, super_index, top first."""
    out = preds.select("id", value)
    for m in memberships:
        out = m.select("id", "super_index").join(out.select(F.col("id").alias("super_index"), value), "super_index").select("id", value)
    return out


def void_nodes(hist: DataFrame, keys: list[str], classes: int, label: str = "label") -> DataFrame:
    """(keys, void): whether more than half of a node's label histogram (keys, label, n) is void."""
    is_void = (F.col(label) < 0) | (F.col(label) >= classes)
    return hist.groupBy(*keys).agg((F.sum(F.when(is_void, F.col("n")).otherwise(0)) * 2 > F.sum("n")).alias("void"))


def size_histogram(sizes: DataFrame, size: str = "node_size") -> DataFrame:
    """(size, n): how many segments have each size."""
    return sizes.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def submission(raw: DataFrame, predicted: DataFrame, r: float, inverse: dict[int, int], value: str = "pred") -> DataFrame:
    """(pid, label): each raw point takes the prediction of the nearest predicted point within r, under its original label."""
    from ..sources.clouds import remapped
    from .neighbors import knn_between

    near = knn_between(raw, predicted, 1, r).select(F.col("i").alias("pid"), "j")
    got = near.join(predicted.select(F.col("pid").alias("j"), value), "j").select("pid", remapped(F.col(value), inverse).alias("label"))
    return raw.select("pid").join(got, "pid", "left")
