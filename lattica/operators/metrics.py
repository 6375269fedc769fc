"""Scores: confusion matrices, panoptic quality, average precision, weighted errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .ids import ranked
from .instances import pair_iou, remove_void

COCO_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def confusion_matrix(rows: DataFrame, classes: int, target: str = "target", pred: str = "pred", weight: str | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, target, pred, n) without void targets."""
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    valid = rows.where((F.col(target) >= 0) & (F.col(target) < classes))
    return valid.groupBy(*keys, F.col(target).alias("target"), F.col(pred).alias("pred")).agg(n.alias("n"))


def from_histogram(hist: DataFrame, keys: list[str], classes: int, label: str = "label") -> DataFrame:
    """The confusion matrix of a long histogram whose groups are predicted by their dominant label."""
    best = hist.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("pred"))
    return confusion_matrix(hist.join(best, keys), classes, label, "pred", "n")


def class_scores(matrix: DataFrame, classes: int, keys: list[str] = ()) -> DataFrame:
    """(keys, class, tp, target_n, pred_n, iou, seen) for every class that occurs, in percent."""
    per = F.posexplode(F.array(F.col("target"), F.col("pred"))).alias("side", "class")
    c = matrix.select(*keys, "target", "pred", "n", per)
    hit = F.col("target") == F.col("pred")
    out = c.groupBy(*keys, "class").agg(
        F.coalesce(F.sum(F.when(hit & (F.col("side") == 0), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("target_n"),
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("n"))), F.lit(0)).alias("pred_n"),
    )
    union = F.col("target_n") + F.col("pred_n") - F.col("tp")
    return out.where(F.col("class") < classes).withColumn("iou", 100 * (1e-8 + F.col("tp") / (union + 1e-8))).withColumn("seen", union > 1e-3)


def semantic_metrics(matrix: DataFrame, classes: int, missing_as_one: bool = False, keys: list[str] = ()) -> DataFrame:
    """(keys, oa, miou, macc) in percent; a class that is not seen is left out, or counted as 1 on request."""
    s = class_scores(matrix, classes, keys)
    total = F.count_if("seen")
    miou = (F.sum(F.when(F.col("seen"), F.col("iou"))) + (classes - total)) / classes if missing_as_one else F.avg(F.when(F.col("seen"), F.col("iou")))
    return s.groupBy(*keys).agg(
        (100 * F.sum("tp") / F.sum("target_n")).alias("oa"),
        miou.alias("miou"),
        (100 * F.avg(F.when(F.col("target_n") > 0, F.col("tp") / F.col("target_n")))).alias("macc"),
    )


def panoptic_quality(table: DataFrame, classes: int, stuff: list[int] = (), keys: list[str] = ()) -> DataFrame:
    """(keys, class, tp, fp, fn, sq, rq, pq, pq_modified) from overlaps with a predicted label pred_y per cluster.

    With keys, such as the fold that a cluster is from, each of their values is scored by itself.

    A pair of equal labels with an IoU above one half is a true positive; it is unique for both sides. For stuff the
    modified quality sums any IoU over the number of targets.
    """
    table = written(table)
    clean = written(remove_void(table, classes))
    keys = list(keys)
    pred = table.select("cluster", "pred_y", *keys).distinct()
    pairs = pair_iou(clean).join(pred, "cluster").withColumn("match", (F.col("y") == F.col("pred_y")))
    hit = F.col("match") & (F.col("iou") > 0.5)
    n_pred = pairs.select("cluster", "pred_y", *keys).distinct().groupBy(*keys, F.col("pred_y").alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    n_target = pairs.select("obj", "y", *keys).distinct().groupBy(*keys, F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("n_target"))
    hits = pairs.where("match").groupBy(*keys, F.col("y").alias("class")).agg(
        F.count_if(hit).alias("tp"), F.sum(F.when(hit, F.col("iou")).otherwise(0.0)).alias("iou_sum"), F.sum("iou").alias("any_iou")
    )
    out = n_pred.join(n_target, [*keys, "class"], "full").join(hits, [*keys, "class"], "left")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(*keys, "class", n0("n_pred").alias("n_pred"), n0("n_target").alias("n_target"), n0("tp").alias("tp"), n0("iou_sum").alias("iou_sum"), n0("any_iou").alias("any_iou"))
    sq = F.when(F.col("tp") > 0, F.col("iou_sum") / F.col("tp")).otherwise(F.lit(0.0))
    rq = 2 * F.col("tp") / (F.col("n_pred") + F.col("n_target"))
    modified = F.when(F.col("class").isin(list(stuff)), F.col("any_iou") / F.greatest(F.col("n_target"), F.lit(1))).otherwise(sq * rq)
    return out.select(
        *keys, "class", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_target") - F.col("tp")).alias("fn"), sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"), modified.alias("pq_modified")
    )


def purity(hist: DataFrame, cluster: str = "cluster", keys: list[str] = ()) -> DataFrame:
    """(keys, purity, n, clusters): the share of points, in percent, whose label is the dominant one of their cluster.

    hist: (keys, cluster, label, n). Folds are keys; without keys all folds count together.
    """
    keys = list(keys)
    each = hist.groupBy(*keys, cluster).agg(F.max("n").alias("_top"), F.sum("n").alias("_all"))
    return each.groupBy(*keys).agg((100 * F.sum("_top") / F.sum("_all")).alias("purity"), F.sum("_all").alias("n"), F.count(F.lit(1)).alias("clusters"))


def average_precision(table: DataFrame, classes: int, thresholds=COCO_THRESHOLDS) -> DataFrame:
    """(class, threshold, n_target, ap, recall) from overlaps with pred_y and score per cluster; thresholds of 0.5 or more.

    At such thresholds a prediction can match one object only and the other way round up to rounding, so that matching is a
    window: of the predictions that reach a target, the one with the best score counts (ties: smaller cluster). Precision
    is made monotone from the right and read at 101 recalls.
    """
    table = written(table)
    clean = written(remove_void(table, classes))
    pred = table.select("cluster", "pred_y", "score").distinct().join(clean.select("cluster").distinct(), "cluster", "left_semi")
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    pairs = pair_iou(clean).join(pred, "cluster").where("y = pred_y").select("cluster", "obj", "y", "iou", "score", t)
    first = Window.partitionBy("threshold", "obj").orderBy(F.desc("score"), "cluster")
    hits = pairs.where("iou > threshold or (iou = threshold and threshold > 0.5)").withColumn("r", F.row_number().over(first)).where("r = 1")
    hits = hits.groupBy("threshold", "cluster").agg(F.lit(1).alias("hit"))
    rows = pred.select("cluster", F.col("pred_y").alias("class"), "score", t).join(hits, ["threshold", "cluster"], "left")
    rows = rows.withColumn("hit", F.coalesce("hit", F.lit(0)))
    n_target = clean.select("obj", "y").distinct().groupBy(F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("n_target"))
    rows = ranked(rows, ["class", "threshold"], [F.desc("score"), "cluster"], "k", ("hit",)).join(F.broadcast(n_target), "class")
    rows = rows.withColumn("recall", F.col("sum_hit") / F.col("n_target"))
    # the best precision at each hundredth of recall or beyond: 101 rows a class at most
    bins = rows.withColumn("bin", F.floor(F.col("recall") * 100 + 1e-9)).groupBy("class", "threshold", "bin").agg(F.max(F.col("sum_hit") / F.col("k")).alias("precision"), F.max("recall").alias("recall"))
    back = Window.partitionBy("class", "threshold").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("class", "threshold").orderBy("bin")
    steps = bins.withColumn("precision", F.max("precision").over(back)).withColumn("before", F.coalesce(F.lag("bin").over(ahead), F.lit(-1)))
    out = steps.groupBy("class", "threshold").agg((F.sum(F.col("precision") * (F.col("bin") - F.col("before"))) / 101).alias("ap"), F.max("recall").alias("recall"))
    every = n_target.select("class", "n_target", t)
    return every.join(out, ["class", "threshold"], "left").select("class", "threshold", "n_target", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def summarize_ap(ap: DataFrame) -> DataFrame:
    """One row: map over all thresholds, map_50, map_75 and mar."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    return ap.agg(F.avg("ap").alias("map"), at(0.5).alias("map_50"), at(0.75).alias("map_75"), F.avg("recall").alias("mar"))


def weighted_error(rows: DataFrame, pred: list[str], target: list[str], norm: int, weight: str | None = None) -> DataFrame:
    """One row `error`: the weighted mean over rows of the summed |difference| to the power of `norm`."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = sum((F.pow(F.abs(F.col(p) - F.col(t)), norm) for p, t in zip(pred[1:], target[1:])), F.pow(F.abs(F.col(pred[0]) - F.col(target[0])), norm))
    return rows.agg((F.sum(w * each) / F.sum(w)).alias("error"))


def class_weights(labels: DataFrame, classes: int, label: str = "y", smooth: str = "sqrt") -> DataFrame:
    """(label, weight): 1 / (count + 1) after smoothing (sqrt, log or none), with a sum of 1."""
    counts = labels.where((F.col(label) >= 0) & (F.col(label) < classes)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    f = {"sqrt": F.sqrt("c"), "log": F.log("c"), "none": F.col("c")}[smooth]
    counts = counts.withColumn("w", 1 / (f + 1))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("w").alias("_s")))).select("label", (F.col("w") / F.col("_s")).alias("weight"))
