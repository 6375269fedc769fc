"""Adjacency graphs, trimming, and edge features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import dense_ids, ranked

XYZ = ("x", "y", "z")


def adjacency(neighbors: DataFrame, k: int, w: float = -1.0) -> DataFrame:
    """(s, t, w): edges to the first k neighbours; weight 1 / (w + d / mean d) if w > 0, else 1."""
    e = neighbors.where(F.col("rank") <= k).select(F.col("i").alias("s"), F.col("j").alias("t"), "d")
    if w <= 0:
        return e.select("s", "t", F.lit(1.0).alias("w"))
    mean = F.broadcast(e.agg(F.avg("d").alias("_m")))
    return e.crossJoin(mean).select("s", "t", (1 / (w + F.col("d") / F.col("_m"))).alias("w"))


_REDUCE = {"mean": F.avg, "add": F.sum, "min": F.min, "max": F.max, "mul": F.product}


def trimmed(edges: DataFrame, reduce: dict[str, str]) -> DataFrame:
    """(s, t, ...): undirected edges s < t without self loops; the attributes of equal edges are reduced (mean, add, min, max, mul)."""
    ends = edges.where("s <> t").select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), *reduce)
    if not reduce:
        return ends.distinct()
    return ends.groupBy("s", "t").agg(*[_REDUCE[how](c).alias(c) for c, how in reduce.items()])


def is_trimmed(edges: DataFrame) -> bool:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s", "t").alias("d"), F.count_if(F.col("s") >= F.col("t")).alias("b")).first()
    return row["n"] == row["d"] and row["b"] == 0


def superedges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(i, j, s, t): point edges between different groups, the points ordered so that s < t. membership: id, super_index."""
    m = membership.select("id", "super_index")
    e = edges.join(m.withColumnsRenamed({"id": "s", "super_index": "_a"}), "s").join(m.withColumnsRenamed({"id": "t", "super_index": "_b"}), "t").where("_a <> _b")
    flip = F.col("_a") > F.col("_b")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    rest = [c for c in edges.columns if c not in ("s", "t")]
    return e.select(pick("s", "t").alias("i"), pick("t", "s").alias("j"), pick("_a", "_b").alias("s"), pick("_b", "_a").alias("t"), *rest)


def with_superedge_ids(edges: DataFrame) -> DataFrame:
    return dense_ids(edges, ["s", "t"], "se_id")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that no edge touches."""
    ends = edges.select(F.col("s").alias("id")).union(edges.select(F.col("t").alias("id")))
    return nodes.join(ends.distinct(), "id", "left_anti")


def connect_isolated(nodes: DataFrame, edges: DataFrame, r: float, k: int = 1, dims=XYZ) -> DataFrame:
    """`edges` (s, t, w) and, for each isolated node, edges to its k nearest within r.

    Their weights follow the least squares line of weight on length over the edges there are.
    """
    from .neighbors import knn_between

    alone = isolated(nodes, edges)
    near = knn_between(alone, nodes, k + 1, r, dims, qid="id", sid="id").where("i <> j")
    w = Window.partitionBy("i").orderBy("d", "j")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    fit = edge_lengths(nodes, edges, dims).agg(F.regr_slope("w", "d").alias("_a"), F.regr_intercept("w", "d").alias("_b"), F.avg("w").alias("_c"))
    new = near.crossJoin(F.broadcast(fit)).select(F.col("i").alias("s"), F.col("j").alias("t"), F.coalesce(F.col("_a") * F.col("d") + F.col("_b"), F.col("_c"), F.lit(1.0)).alias("w"))
    return edges.select("s", "t", "w").union(new)


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """`edges` with s_<c> and t_<c> of their two nodes."""
    for end in ("s", "t"):
        edges = edges.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


def edge_lengths(nodes: DataFrame, edges: DataFrame, dims=XYZ) -> DataFrame:
    d2 = sum(((F.col(f"s_{d}") - F.col(f"t_{d}")) * (F.col(f"s_{d}") - F.col(f"t_{d}")) for d in dims[1:]), (F.col(f"s_{dims[0]}") - F.col(f"t_{dims[0]}")) * (F.col(f"s_{dims[0]}") - F.col(f"t_{dims[0]}")))
    return with_ends(edges, nodes, list(dims)).select(*edges.columns, F.sqrt(d2).alias("d"))


def minimal_edge_features(subedges: DataFrame, points: DataFrame) -> DataFrame:
    """(s, t, mean_off_x/y/z, std_off, mean_dist) of each superedge from its point pairs (i, j, s, t).

    Offsets run from source to target; mean_dist is the root of the mean length; the spread is the root mean square of the
    offsets about their mean, clipped to 2.
    """
    p = points.select(F.col("pid"), *XYZ)
    e = subedges.join(p.withColumnsRenamed({"pid": "i", "x": "ix", "y": "iy", "z": "iz"}), "i").join(p.withColumnsRenamed({"pid": "j", "x": "jx", "y": "jy", "z": "jz"}), "j")
    for d in XYZ:
        e = e.withColumn(f"o{d}", F.col(f"j{d}") - F.col(f"i{d}"))
    length = F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") + F.col("oz") * F.col("oz"))
    spread = F.sqrt(F.var_pop("ox") + F.var_pop("oy") + F.var_pop("oz"))
    return e.groupBy("s", "t").agg(
        *[F.avg(f"o{d}").alias(f"mean_off_{d}") for d in XYZ],
        F.least(F.lit(2.0), spread).alias("std_off"),
        F.sqrt(F.avg(length)).alias("mean_dist"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def _centroid_terms() -> list:
    off = {d: F.col(f"t_{d}") - F.col(f"s_{d}") for d in XYZ}
    length = F.sqrt(off["x"] * off["x"] + off["y"] * off["y"] + off["z"] * off["z"])
    safe = F.when(length > 0, length).otherwise(F.lit(1.0))
    return [*[(off[d] / safe).alias(f"dir_{d}") for d in XYZ], F.sqrt(length).alias("centroid_dist")]


def both_directions(edges: DataFrame, odd: list[str] = ()) -> DataFrame:
    """Each trimmed edge in both directions; the `odd` attributes change sign on the way back."""
    back = edges.select(*[(-F.col(c) if c in odd else F.col("t") if c == "s" else F.col("s") if c == "t" else F.col(c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def horizontal_edge_features(edges: DataFrame, nodes: DataFrame, logs: list[str] = (), normals: bool = False) -> DataFrame:
    """Edges in both directions with the unit centroid direction, the root of the centroid distance, differences of the
    `logs` columns (target less source) and, if asked for, the cosine between the normals (nx, ny, nz)."""
    own = [*XYZ, *logs, *(["nx", "ny", "nz"] if normals else [])]
    e = with_ends(both_directions(edges.select("s", "t")), nodes, own)
    extra = [(F.col(f"t_{c}") - F.col(f"s_{c}")).alias(f"d_{c}") for c in logs]
    if normals:
        extra.append(F.abs(sum((F.col(f"s_n{d}") * F.col(f"t_n{d}") for d in "yz"), F.col("s_nx") * F.col("t_nx"))).alias("normal_angle"))
    return e.select("s", "t", *_centroid_terms(), *extra)


def vertical_edge_features(children: DataFrame, parents: DataFrame, logs: list[str] = ()) -> DataFrame:
    """(s, t, ...): each child (s) with its parent (t), by the same features."""
    e = children.select(F.col("id").alias("s"), F.col("super_index").alias("t"), *[F.col(c).alias(f"s_{c}") for c in (*XYZ, *logs)])
    e = e.join(parents.select(F.col("id").alias("t"), *[F.col(c).alias(f"t_{c}") for c in (*XYZ, *logs)]), "t")
    return e.select("s", "t", *_centroid_terms(), *[(F.col(f"t_{c}") - F.col(f"s_{c}")).alias(f"d_{c}") for c in logs])


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`edges` and a loop (id, id) for each node, whose attributes are 0."""
    rest = [f for f in edges.schema if f.name not in ("s", "t")]
    return edges.unionByName(nodes.select(F.col("id").alias("s"), F.col("id").alias("t"), *[F.lit(0).cast(f.dataType).alias(f.name) for f in rest]))


def border_pairs(points: DataFrame, edges: DataFrame, group: str, ratio: float = 0.2, k_min: int = 20) -> DataFrame:
    """(s, t, i, j, rank): for each pair of groups, points of their facing borders matched one to one.

    The axis runs between the two groups' closest points. Each side's points are ordered by how far they lie from the
    other group along it; the nearest `ratio` (at least k_min, at most all, the same number on both sides) are ordered
    across the axis and paired by rank.
    """
    from .neighbors import nearest_pairs

    ends = nearest_pairs(points, edges, group)
    p = points.select("pid", *XYZ)
    for end, e in (("i", "a"), ("j", "b")):
        ends = ends.join(p.select(F.col("pid").alias(end), *[F.col(d).alias(f"{e}{d}") for d in XYZ]), end)
    axis = [(F.col(f"b{d}") - F.col(f"a{d}")) for d in XYZ]
    ends = ends.select("s", "t", *[c.alias(f"u{d}") for c, d in zip(axis, XYZ)], *[F.col(f"a{d}") for d in XYZ])
    # a direction across the axis: its cross product with the coordinate axis that it leans on least
    lean = F.abs("uz") < F.abs("ux")
    across = (F.when(lean, -F.col("uy")).otherwise(F.lit(0.0)), F.when(lean, F.col("ux")).otherwise(F.col("uz")), F.when(lean, F.lit(0.0)).otherwise(-F.col("uy")))
    sides = []
    for end, sign in (("s", -1.0), ("t", 1.0)):
        rows = ends.join(points.select(F.col(group).alias(end), "pid", *XYZ), end)
        along = sum((F.col(f"u{d}") * (F.col(d) - F.col(f"a{d}")) for d in "yz"), F.col("ux") * (F.col("x") - F.col("ax")))
        over = across[0] * F.col("x") + across[1] * F.col("y") + across[2] * F.col("z")
        rows = rows.select("s", "t", "pid", (sign * along).alias("along"), over.alias("over"))
        counts = rows.groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))
        sides.append(ranked(rows, ["s", "t"], ["along", "pid"], "r").join(counts, ["s", "t"]))
    take = lambda n: F.least(n, F.greatest(F.lit(k_min), F.ceil(n * ratio)))
    sizes = sides[0].select("s", "t", F.col("n").alias("n1")).distinct().join(sides[1].select("s", "t", F.col("n").alias("n2")).distinct(), ["s", "t"])
    sizes = sizes.select("s", "t", F.least(take(F.col("n1")), take(F.col("n2"))).alias("k"))
    a, b = [ranked(x.join(sizes, ["s", "t"]).where("r <= k").select("s", "t", "pid", "over"), ["s", "t"], ["over", "pid"]).drop("over") for x in sides]
    return a.withColumnRenamed("pid", "i").join(b.withColumnRenamed("pid", "j"), ["s", "t", "rank"]).select("s", "t", "i", "j", "rank")
