"""Sweeps over settings of instance partitions, on segments with label shares as logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panoptic, partition
from .fixtures import CLASSES, overlap_table, query, segment_edges, segments

#: Settings of the sweep over connected affinities, and the linear function of an edge's length that stands for its logit.
THRESHOLDS = [0.2, 0.4, 0.6, 0.8]
LOGIT = (2.5, -1.7)


def _nodes(spark, d):
    """(id, n, x, logits): positions in hundreds; the share of each label, with small differences so that none are equal."""
    share = [(F.count_if(F.col("lab") == k) / F.count(F.lit(1)) - 0.013 * k) for k in range(CLASSES)]
    mean = F.array(*[F.avg(c) / 100 for c in "xyz"])
    return segments(spark, d).groupBy(F.col("super_index").alias("id")).agg(F.count(F.lit(1)).alias("n"), mean.alias("x"), F.array(*share).alias("logits"))


def _edges(spark, d):
    return segment_edges(spark, d).select("s", "t", (LOGIT[0] + LOGIT[1] * F.col("d")).alias("logit"))


_SHARES = ", ".join(f"count(*) FILTER (WHERE lab = {k}) / count(*) - 0.013::DOUBLE * {k} AS l{k}" for k in range(CLASSES))
_MEANS = ", ".join(f"sum(l{k} * n) / sum(n)" for k in range(CLASSES))
_INSTANCES = f"""WITH RECURSIVE nd AS (SELECT super_index AS id, count(*) AS n, {_SHARES} FROM seg GROUP BY 1),
st AS (SELECT row_number() OVER () - 1 AS k, th FROM (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS th)),
e AS (SELECT k, s, t FROM sedge, st WHERE 1 / (1 + exp(-({LOGIT[0]}::DOUBLE + {LOGIT[1]}::DOUBLE * d))) > th),
e2 AS (SELECT k, s, t FROM e UNION ALL SELECT k, t, s FROM e),
reach AS (SELECT k, id, id AS b FROM nd, st UNION SELECT reach.k, reach.id, e2.t FROM reach JOIN e2 ON e2.k = reach.k AND e2.s = reach.b),
lab0 AS (SELECT k, id, max(b) AS label FROM reach GROUP BY 1, 2),
cls AS (SELECT k, label, list_position(m, list_max(m)) - 1 AS y FROM (SELECT k, label, [{_MEANS}] AS m FROM lab0 JOIN nd USING (id) GROUP BY 1, 2)),
inst AS (SELECT k, id, CASE WHEN y = 0 THEN min(label) OVER (PARTITION BY k, y) ELSE label END AS label, y FROM lab0 JOIN cls USING (k, label))"""

_SCORES = f""", tb AS (SELECT k, label AS cluster, obj, sum(cnt) AS cnt, min(ov.y) AS y, min(inst.y) AS pred_y FROM ov JOIN inst ON inst.id = ov.cluster GROUP BY 1, 2, 3),
gone AS (SELECT *, 2 * sum(CASE WHEN y >= {CLASSES} THEN cnt ELSE 0 END) OVER (PARTITION BY k, cluster) > sum(cnt) OVER (PARTITION BY k, cluster) AS gone FROM tb),
cr AS (SELECT *, sum(CASE WHEN gone THEN cnt ELSE 0 END) OVER (PARTITION BY k, obj) AS cropped FROM gone),
iou AS (SELECT *, cnt / (sum(cnt) OVER (PARTITION BY k, cluster) + sum(cnt) OVER (PARTITION BY k, obj) + cropped - cnt) AS iou FROM cr WHERE NOT gone AND y < {CLASSES}),
np AS (SELECT k, pred_y AS class, count(DISTINCT cluster) AS n_pred FROM iou GROUP BY 1, 2), nt AS (SELECT k, y AS class, count(DISTINCT obj) AS n_target FROM iou GROUP BY 1, 2),
h AS (SELECT k, y AS class, count(*) FILTER (WHERE iou > 0.5) AS tp, coalesce(sum(iou) FILTER (WHERE iou > 0.5), 0) AS si, sum(iou) AS anyiou FROM iou WHERE y = pred_y GROUP BY 1, 2),
q AS (SELECT k, class, coalesce(n_pred, 0) AS n_pred, coalesce(n_target, 0) AS n_target, coalesce(tp, 0) AS tp, coalesce(si, 0) AS si, coalesce(anyiou, 0) AS anyiou
FROM np FULL JOIN nt USING (k, class) LEFT JOIN h USING (k, class)),
f AS (SELECT *, CASE WHEN tp > 0 THEN si / tp ELSE 0 END AS sq, 2 * tp / (n_pred + n_target) AS rq FROM q),
sc AS (SELECT k, avg(sq * rq) AS pq, avg(sq) AS sq, avg(rq) AS rq, avg(CASE WHEN class = 0 THEN anyiou / greatest(n_target, 1) ELSE sq * rq END) AS pq_modified FROM f GROUP BY 1),
o AS (SELECT CAST(k AS INTEGER) AS setting_id, round(th, 6) AS threshold, round(pq, 6) AS pq, round(sq, 6) AS sq, round(rq, 6) AS rq, round(pq_modified, 6) AS pq_modified FROM st LEFT JOIN sc USING (k))"""


@query(f"{_INSTANCES} SELECT CAST(k AS INTEGER) AS setting_id, id, label, CAST(y AS INTEGER) AS y FROM inst", "seg sedge")
def instances_by_setting(spark, d):
    nodes = _nodes(spark, d)
    labels = panoptic.by_affinity(nodes, _edges(spark, d), panoptic.grid(threshold=THRESHOLDS))
    return panoptic.classified(labels, nodes, [0]).drop("score")


def _sweep(spark, d):
    return panoptic.sweep(_nodes(spark, d), _edges(spark, d), overlap_table(spark, d), panoptic.grid(threshold=THRESHOLDS), CLASSES, [0], "affinity")


@query(f"{_INSTANCES}{_SCORES} SELECT * FROM o", "seg sedge ov")
def panoptic_sweep(spark, d):
    return _sweep(spark, d)


@query(f"{_INSTANCES}{_SCORES} SELECT * FROM o ORDER BY pq DESC, setting_id LIMIT 1", "seg sedge ov")
def panoptic_best_setting(spark, d):
    return partition.sweep(_sweep(spark, d), "pq")


@query()
def panoptic_energy_sweep(spark, d):
    settings = panoptic.grid(regularization=[0.02, 0.2], p_weight=[0.5, 2.0], discrepancy_epsilon=0.1)
    return panoptic.sweep(_nodes(spark, d), _edges(spark, d), overlap_table(spark, d), settings, CLASSES, [0], min_size=4)
