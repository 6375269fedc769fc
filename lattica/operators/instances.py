"""Overlaps between clusters and annotated objects: (cluster, obj, cnt, y). Labels outside 0..C-1 are void."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def overlaps(points: DataFrame, cluster: str, obj: str = "obj", label: str = "y") -> DataFrame:
    return points.groupBy(F.col(cluster).alias("cluster"), F.col(obj).alias("obj")).agg(F.count(F.lit(1)).alias("cnt"), F.min(label).alias("y"))


def merge_overlaps(table: DataFrame, parents: DataFrame) -> DataFrame:
    """The overlaps of the parents. parents: cluster, super_index."""
    rows = table.join(parents, "cluster")
    return rows.groupBy(F.col("super_index").alias("cluster"), "obj").agg(F.sum("cnt").alias("cnt"), F.min("y").alias("y"))


def _void(y: Column, classes: int) -> Column:
    return (y < 0) | (y >= classes)


def major(table: DataFrame, classes: int | None = None) -> DataFrame:
    """(cluster, obj, cnt, y): each cluster's largest overlap, ties to the smaller object.

    If a cluster whose largest overlap is void has no more than half of itself there, every such cluster that has one
    takes its largest overlap that isn't void.
    """
    pick = lambda cond: F.max_by(F.struct("obj", "cnt", "y"), F.when(cond, F.struct("cnt", -F.col("obj"))))
    best = table.groupBy("cluster").agg(
        pick(F.lit(True)).alias("b"),
        *([pick(~_void(F.col("y"), classes)).alias("v"), F.sum("cnt").alias("n"), F.max(~_void(F.col("y"), classes)).alias("any")] if classes is not None else []),
    )
    if classes is None:
        return best.select("cluster", "b.*")
    void = _void(F.col("b.y"), classes)
    rule = F.broadcast(best.agg(F.coalesce(F.max(void & (F.col("b.cnt") * 2 <= F.col("n"))), F.lit(False)).alias("_move")))
    out = best.crossJoin(rule).withColumn("b", F.when(F.col("_move") & void & F.col("any"), F.col("v")).otherwise(F.col("b")))
    return out.select("cluster", "b.*")


def pair_iou(table: DataFrame) -> DataFrame:
    """`table` with the sizes of cluster (a) and object (b) and the IoU of each pair. Sizes are sums that join back."""
    a = table.groupBy("cluster").agg(F.sum("cnt").alias("a"))
    b = table.groupBy("obj").agg(F.sum("cnt").alias("b"), *([F.max("cropped").alias("_c")] if "cropped" in table.columns else []))
    out = table.join(a, "cluster").join(b, "obj")
    if "cropped" in table.columns:
        out = out.withColumn("b", F.col("b") + F.col("_c")).drop("_c")
    return out.withColumn("iou", F.col("cnt") / (F.col("a") + F.col("b") - F.col("cnt")))


def remove_void(table: DataFrame, classes: int) -> DataFrame:
    """The overlaps without clusters that are void by more than half and without void objects.

    `cropped` is how much of an object went with the clusters, so that IoU denominators can still count it.
    """
    is_void = _void(F.col("y"), classes)
    share = table.groupBy("cluster").agg(F.sum("cnt").alias("_n"), F.sum(F.when(is_void, F.col("cnt")).otherwise(0)).alias("_v"))
    rows = table.join(share, "cluster").withColumn("_gone", F.col("_v") * 2 > F.col("_n"))
    cropped = rows.groupBy("obj").agg(F.sum(F.when(F.col("_gone"), F.col("cnt")).otherwise(0)).alias("cropped"))
    return rows.where(~F.col("_gone") & ~is_void).join(cropped, "obj").select("cluster", "obj", "cnt", "y", "cropped")


def object_centroids(table: DataFrame, clusters: DataFrame, mode: str = "iou") -> DataFrame:
    """(obj, x, y, z): means of cluster positions (cluster, px, py, pz) weighted by iou, product-iou or overlap."""
    rows = pair_iou(table.select("cluster", "obj", "cnt"))
    w = {"iou": F.col("iou"), "product-iou": F.col("cnt") * F.col("cnt") / (F.col("a") * F.col("b")), "overlap": F.col("cnt")}[mode]
    rows = rows.withColumn("_w", w).join(clusters, "cluster")
    return rows.groupBy("obj").agg(*[(F.sum(F.col("_w") * F.col(f"p{d}")) / F.sum("_w")).alias(f"c{d}") for d in "xyz"])


def target_histogram(table: DataFrame, classes: int) -> DataFrame:
    """(cluster, label, n): label histogram in long form, void as `classes`."""
    return table.groupBy("cluster", F.when(_void(F.col("y"), classes), F.lit(classes)).otherwise(F.col("y")).alias("label")).agg(F.sum("cnt").alias("n"))


def edge_affinity(edges: DataFrame, table: DataFrame, smooth: bool = True, classes: int | None = None) -> DataFrame:
    """(s, t, affinity): how much two clusters belong to one object.

    Smooth: the mean share that each has in the other's major object. Hard: 1 if the major objects are the same, else 0.
    """
    m = major(table, classes).select("cluster", "obj")
    e = edges.select("s", "t")
    for end in ("s", "t"):
        e = e.join(m.withColumnsRenamed({"cluster": end, "obj": f"{end}_obj"}), end)
    if not smooth:
        return e.select("s", "t", (F.col("s_obj") == F.col("t_obj")).cast("double").alias("affinity"))
    n = table.groupBy("cluster").agg(F.sum("cnt").alias("n"))
    part = table.select("cluster", "obj", "cnt").join(n, "cluster").select("cluster", "obj", (F.col("cnt") / F.col("n")).alias("part"))
    for end, other in (("s", "t"), ("t", "s")):
        own = part.withColumnsRenamed({"cluster": end, "obj": f"{other}_obj", "part": f"{end}_part"})
        e = e.join(own, [end, f"{other}_obj"], "left")
    return e.select("s", "t", (0.5 * (F.coalesce("s_part", F.lit(0.0)) + F.coalesce("t_part", F.lit(0.0)))).alias("affinity"))


def void_edges(edges: DataFrame, void: DataFrame) -> DataFrame:
    """`edges` with `void`: whether both ends are. void: (id, void); nodes that it lacks aren't void."""
    e = edges
    for end in ("s", "t"):
        e = e.join(void.select(F.col("id").alias(end), F.col("void").alias(f"_{end}")), end, "left")
    return e.withColumn("void", F.coalesce("_s", F.lit(False)) & F.coalesce("_t", F.lit(False))).drop("_s", "_t")


def sanitized_affinities(edges: DataFrame, table: DataFrame, classes: int, smooth: bool = True) -> DataFrame:
    """(s, t, affinity, same_class, same_obj) of the edges that don't link two void clusters, for the affinity loss.

    A cluster is void where more than half of its points are; class and object are those of its major overlap.
    """
    void = table.groupBy(F.col("cluster").alias("id")).agg((F.sum(F.when(_void(F.col("y"), classes), F.col("cnt")).otherwise(0)) * 2 > F.sum("cnt")).alias("void"))
    e = edge_affinity(void_edges(edges.select("s", "t"), void).where("not void"), table, smooth)
    m = major(table)
    for end in ("s", "t"):
        e = e.join(m.select(F.col("cluster").alias(end), F.col("obj").alias(f"_o{end}"), F.col("y").alias(f"_y{end}")), end)
    return e.select("s", "t", "affinity", (F.col("_ys") == F.col("_yt")).alias("same_class"), (F.col("_os") == F.col("_ot")).alias("same_obj"))


def oracle_clusters(table: DataFrame, classes: int) -> DataFrame:
    """(cluster, obj, cnt, y, pred_y, score): clusters with one major object become one prediction, scored by its IoU."""
    table = written(table)
    m = written(major(table, classes).select("cluster", F.col("obj").alias("super_index"), F.col("y").alias("pred_y")))
    merged = written(merge_overlaps(table, m.select("cluster", "super_index")))
    label = m.groupBy(F.col("super_index").alias("cluster")).agg(F.min("pred_y").alias("pred_y"))
    best = pair_iou(merged).groupBy("cluster").agg(F.max_by("iou", F.struct("cnt", -F.col("obj"))).alias("score"))
    return merged.join(label, "cluster").join(best, "cluster")


def merge_stuff(points: DataFrame, stuff: list[int], classes: int, keys: list[str] = ()) -> DataFrame:
    """Labels outside 0..C-1 become C; all points of a stuff or void class get the smallest object id among them."""
    out = points.withColumn("y", F.when(_void(F.col("y"), classes), F.lit(classes)).otherwise(F.col("y")))
    low = out.where(F.col("y").isin([*stuff, classes])).groupBy(*keys, "y").agg(F.min("obj").alias("_obj"))
    return out.join(low, [*keys, "y"], "left").withColumn("obj", F.coalesce("_obj", "obj")).drop("_obj")


def clusters_summary(table: DataFrame) -> DataFrame:
    """One row: how many clusters, overlaps and objects."""
    return table.agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("overlaps"), F.count_distinct("obj").alias("objects"))


def with_set_ids(overlaps_by_batch: DataFrame) -> DataFrame:
    """Overlaps of several batches as one table: objects and clusters stay apart by their batch."""
    return overlaps_by_batch.withColumn("cluster", F.struct("batch", "cluster")).withColumn("obj", F.struct("batch", "obj"))


def top_overlaps(table: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.desc("cnt"), "obj")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
