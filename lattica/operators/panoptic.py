"""Instances of a graph of segments under many settings at once, and which setting scores best.

The setting is part of every key: a node, an edge or an instance of setting k is the pair (k, id). All settings so go through
the same jobs, and what doesn't depend on the setting (nodes, edges, overlaps with objects) is read once for all of them.
Settings are a short list that the caller writes; rows are multiplied by it in place, without a join.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import argmax, sigmoid, softmax
from ..storage import written
from . import metrics, nn, partition


def grid(**values) -> list[dict]:
    """The settings of all combinations of values (a list, or one value), numbered by setting_id in their order."""
    lists = [v if isinstance(v, (list, tuple)) else [v] for v in values.values()]
    return [{"setting_id": i, **dict(zip(values, v))} for i, v in enumerate(product(*lists))]


def by_setting(df: DataFrame, settings: list[dict]) -> DataFrame:
    """`df` once for each setting, with its values as columns."""
    return df.select("*", F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in settings])))


def _key(name: str):
    return F.struct(F.col("setting_id").alias("k"), F.col(name).cast("long").alias("id")).alias(name)


def _plain(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id.k").alias("setting_id"), F.col("id.id").alias("id"), F.col("label.id").alias("label"))


def shifted(nodes: DataFrame, stuff: list[int]) -> DataFrame:
    """`nodes` (x, offset and logits arrays) with x moved by the offset, but for nodes whose best class is stuff."""
    moved = F.zip_with("x", "offset", lambda a, b: a + b)
    return nodes.withColumn("x", F.when(argmax(F.col("logits")).isin(list(stuff)), F.col("x")).otherwise(moved))


def affinity_logits(edges: DataFrame, nodes: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """`edges` (s, t) with logit: a linear head over |x_s - x_t| and (x_s + x_t) / 2, which are the same both ways around.

    nodes: id and feature array x. weights: twice as many as x is long.
    """
    ends = edges.join(nodes.select(F.col("id").alias("s"), F.col("x").alias("_a")), "s").join(nodes.select(F.col("id").alias("t"), F.col("x").alias("_b")), "t")
    pair = F.concat(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b)), F.zip_with("_a", "_b", lambda a, b: (a + b) / 2))
    w = F.array(*[F.lit(float(v)) for v in weights])
    logit = F.aggregate(F.zip_with(pair, w, lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
    return ends.withColumn("logit", logit).drop("_a", "_b")


def by_affinity(nodes: DataFrame, edges: DataFrame, settings: list[dict]) -> DataFrame:
    """(setting_id, id, label): connected components over the edges (s, t, logit) whose affinity is above `threshold`.

    settings: setting_id and threshold. The label is the largest id of a component.
    """
    of = by_setting(nodes.select("id"), settings).select(_key("id"))
    linked = by_setting(edges.select("s", "t", "logit"), settings).where(sigmoid(F.col("logit")) > F.col("threshold")).select(_key("s"), _key("t"))
    return _plain(partition.components(of, linked))


def by_energy(nodes: DataFrame, edges: DataFrame, settings: list[dict], min_size: int = 1, solver: str = "merge") -> DataFrame:
    """(setting_id, id, label): the partition that lowers an energy of positions, class probabilities and affinities.

    nodes: id, n, x and logits arrays. edges: s, t, logit. settings: setting_id and any of regularization (1e-2), x_weight (1),
    p_weight (1), discrepancy_epsilon (1e-4), temperature (1), dampening (0). Differences are squared ones, in positions
    and in probabilities. An edge weighs regularization a / (1 - a + eps), a its affinity. The energy is lowered from single
    nodes up (`merge`, `partition.greedy_merge`) or by splits from the whole down (`cut`, `partition.cut_pursuit`, which takes
    many more rounds); segments of less than min_size are merged. The label is the id of a node.
    """
    full = [{"regularization": 1e-2, "x_weight": 1.0, "p_weight": 1.0, "discrepancy_epsilon": 1e-4, "temperature": 1.0, "dampening": 0.0} | s for s in settings]
    full = [{k: v if k == "setting_id" else float(v) for k, v in s.items()} for s in full]
    p = softmax(F.transform("logits", lambda v: v / F.col("temperature")))
    p = F.transform(p, lambda v: (1 - F.col("dampening")) * v + F.col("dampening") / F.size("logits"))
    scaled = lambda arr, w: F.transform(arr, lambda v: v * F.sqrt(F.col(w)))
    of = by_setting(nodes.select("id", F.col("n").cast("double").alias("n"), F.col("x").cast("array<double>").alias("x"), F.col("logits").cast("array<double>").alias("logits")), full)
    of = written(of.select(_key("id"), "n", F.concat(scaled("x", "x_weight"), scaled(p, "p_weight")).alias("x")))
    a = sigmoid(F.col("logit"))
    w = F.col("regularization") * a / (1 - a + F.col("discrepancy_epsilon"))
    linked = written(by_setting(edges.select("s", "t", "logit"), full).select(_key("s"), _key("t"), w.alias("w")))
    if solver == "merge":
        return _plain(partition.greedy_merge(of, linked, 1.0, min_size))
    labels = partition.cut_pursuit(of, linked, 1.0)
    return _plain(labels if min_size <= 1 else _without_small(of, linked, labels, min_size))


def _without_small(nodes: DataFrame, edges: DataFrame, labels: DataFrame, min_size: int) -> DataFrame:
    """The labels after segments under min_size have merged with their neighbours."""
    labels = written(labels)
    rows = nodes.join(labels, "id").select("label", "n", F.posexplode("x").alias("k", "v"))
    mean = rows.groupBy("label", "k").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
    mean = mean.groupBy("label").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "v"))).alias("x"))
    segments = mean.select(F.col("label").alias("id"), "n", F.transform("x", lambda e: e["v"]).alias("x"))
    ends = edges.join(labels.withColumnsRenamed({"id": "s", "label": "_a"}), "s").join(labels.withColumnsRenamed({"id": "t", "label": "_b"}), "t")
    between = ends.where("_a <> _b").select(F.col("_a").alias("s"), F.col("_b").alias("t"), "w")
    to = partition.greedy_merge(segments, between, 1.0, min_size).select(F.col("id").alias("label"), F.col("label").alias("_to"))
    return labels.join(to, "label").select("id", F.col("_to").alias("label"))


def classified(labels: DataFrame, nodes: DataFrame, stuff: list[int] = ()) -> DataFrame:
    """(setting_id, id, label, y, score): labels (setting_id, id, label) with each instance's class and its probability.

    The class is that of the size-weighted mean logits of the instance's nodes (id, n, logits; optionally batch). Instances of
    one stuff class are one instance in each batch: that of the least label.
    """
    keys = ["setting_id", *(["batch"] if "batch" in nodes.columns else [])]

    def predicted(rows: DataFrame) -> DataFrame:
        of = nn.instance_prediction(rows.withColumn("instance", F.struct("setting_id", "label")), "instance", "logits", "n")
        return of.select(F.col("instance.setting_id").alias("setting_id"), F.col("instance.label").alias("label"), of["label"].alias("y"), "score")

    rows = labels.join(nodes.select("id", "n", "logits", *keys[1:]), "id")
    merged = partition.stuff_merged(rows.join(predicted(rows).drop("score"), ["setting_id", "label"]), list(stuff), keys).drop("y")
    return merged.join(predicted(merged), ["setting_id", "label"]).select("setting_id", "id", "label", "y", "score")


def merged_overlaps(instances: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(setting_id, cluster, obj, cnt, y, pred_y, score): overlaps (cluster, obj, cnt, y) of nodes as those of instances.

    Clusters and objects are pairs with the setting, so that settings can be scored side by side.
    """
    rows = overlaps.join(instances.select("setting_id", F.col("id").alias("cluster"), F.col("label"), F.col("y").alias("pred_y"), "score"), "cluster")
    out = rows.groupBy("setting_id", "label", "obj").agg(F.sum("cnt").alias("cnt"), F.min("y").alias("y"), F.first("pred_y").alias("pred_y"), F.first("score").alias("score"))
    pair = lambda c: F.struct(F.col("setting_id").alias("k"), F.col(c).alias("id"))
    return out.select("setting_id", pair("label").alias("cluster"), pair("obj").alias("obj"), "cnt", "y", "pred_y", "score")


def scores(table: DataFrame, classes: int, stuff: list[int] = ()) -> DataFrame:
    """(setting_id, pq, sq, rq, pq_modified): means over the classes that a setting's predictions or targets have."""
    each = metrics.panoptic_quality(table, classes, list(stuff), ["setting_id"])
    return each.groupBy("setting_id").agg(*[F.avg(c).alias(c) for c in ("pq", "sq", "rq", "pq_modified")])


def sweep(nodes: DataFrame, edges: DataFrame, overlaps: DataFrame, settings: list[dict], classes: int, stuff: list[int] = (), method: str = "energy", min_size: int = 1) -> DataFrame:
    """(setting_id, its values, pq, sq, rq, pq_modified) of each setting; `partition.sweep` picks the best.

    method: `energy` for `by_energy`, `affinity` for `by_affinity`.
    """
    labels = by_affinity(nodes, edges, settings) if method == "affinity" else by_energy(nodes, edges, settings, min_size)
    found = merged_overlaps(classified(written(labels), nodes, stuff), overlaps)
    values = by_setting(nodes.sparkSession.range(1), settings).drop("id")
    return values.join(scores(found, classes, stuff), "setting_id", "left")
