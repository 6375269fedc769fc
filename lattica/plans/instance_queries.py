"""Overlaps between clusters and objects, and the scores made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collate, graph, hierarchy, instances, metrics, voxels
from ..sources import catalog
from .fixtures import CLASSES, overlap_table, points, predicted, query, segment_edges, segment_nodes, segments

_CONF = """WITH h AS (SELECT cx, cy, cz, lab, count(*) AS n FROM vox GROUP BY ALL),
p AS (SELECT cx, cy, cz, lab AS pred FROM h QUALIFY row_number() OVER (PARTITION BY cx, cy, cz ORDER BY n DESC, lab) = 1),
m AS (SELECT lab AS target, pred, CAST(sum(n) AS BIGINT) AS n FROM h JOIN p USING (cx, cy, cz) WHERE lab < 4 GROUP BY 1, 2)"""
_SCORES = f"""{_CONF}, c AS (SELECT unnest([0, 1, 2, 3]) AS class), s AS (SELECT class, coalesce(sum(n) FILTER (WHERE target = class AND pred = class), 0) AS tp,
coalesce(sum(n) FILTER (WHERE target = class), 0) AS target_n, coalesce(sum(n) FILTER (WHERE pred = class), 0) AS pred_n FROM c, m GROUP BY 1),
u AS (SELECT CAST(class AS INTEGER) AS class, CAST(tp AS BIGINT) AS tp, CAST(target_n AS BIGINT) AS target_n, CAST(pred_n AS BIGINT) AS pred_n, 100 * (1e-8::DOUBLE + tp / (target_n + pred_n - tp + 1e-8::DOUBLE)) AS iou FROM s)"""


def _matrix(spark, d):
    rows = voxels.with_cells(points(spark, d), (10.0, 10.0, 10.0))
    return metrics.from_histogram(voxels.histogram(rows, ["cx", "cy", "cz"], "lab").withColumnRenamed("lab", "label"), ["cx", "cy", "cz"], CLASSES)


@query(f"{_CONF} SELECT target, pred, n FROM m", "vox")
def oracle_confmat(spark, d):
    return _matrix(spark, d)


@query(f"{_SCORES} SELECT class, tp, target_n, pred_n, round(iou, 6) AS iou, target_n + pred_n - tp > 0 AS seen FROM u", "vox")
def class_scores(spark, d):
    return metrics.class_scores(_matrix(spark, d), CLASSES)


@query(f"{_SCORES} SELECT round(100 * sum(tp) / sum(target_n), 6) AS oa, round(avg(iou), 6) AS miou, round(100 * avg(tp / target_n), 6) AS macc FROM u", "vox")
def semantic_metrics(spark, d):
    return metrics.semantic_metrics(_matrix(spark, d), CLASSES)


@query("SELECT fold, round(100 * count(*) FILTER (WHERE pred = lab) / count(*), 6) AS oa FROM (SELECT pid % 4 AS fold, lab, pid * 7 % 4 AS pred FROM pts WHERE lab < 4) GROUP BY 1")
def fold_rollup(spark, d):
    rows = points(spark, d).select(F.pmod("pid", F.lit(4)).alias("fold"), F.col("lab").alias("target"), F.pmod(F.col("pid") * 7, F.lit(4)).cast("int").alias("pred"))
    return metrics.semantic_metrics(metrics.confusion_matrix(rows, CLASSES, keys=["fold"]), CLASSES, keys=["fold"]).select("fold", "oa")


@query("SELECT fold, round(100 * sum(top) / sum(n), 6) AS purity, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters FROM (SELECT fold, obj, max(n) AS top, sum(n) AS n FROM (SELECT pid % 6 AS fold, obj, lab, count(*) AS n FROM pts GROUP BY ALL) GROUP BY ALL) GROUP BY 1")
def purity_folds(spark, d):
    hist = points(spark, d).select(F.pmod("pid", F.lit(6)).alias("fold"), "obj", "lab").groupBy("fold", "obj", "lab").agg(F.count(F.lit(1)).alias("n"))
    return metrics.purity(hist, "obj", ["fold"])


@query(
    """SELECT label, name, kind, count(pid) AS points FROM (VALUES (0, 'Ground', 'stuff'), (1, 'Vegetation', 'stuff'), (2, 'Cars', 'thing'), (3, 'Trucks', 'thing'), (4, 'Power lines', 'thing'), (5, 'Fences', 'thing'), (6, 'Poles', 'thing'), (7, 'Buildings', 'thing'), (8, 'void', 'void')) t(label, name, kind)
    LEFT JOIN pts ON label = CASE WHEN pid % 10 BETWEEN 1 AND 8 THEN pid % 10 - 1 ELSE 8 END GROUP BY 1, 2, 3"""
)
def aerial_classes(spark, d):
    own = points(spark, d).select(catalog.DALES.label(F.pmod("pid", F.lit(10))).alias("label"))
    counts = own.groupBy("label").agg(F.count(F.lit(1)).alias("points"))
    return catalog.DALES.classes(spark).join(counts, "label", "left").select("label", "name", "kind", F.coalesce("points", F.lit(0)).alias("points"))


@query("SELECT pid, CASE pid % 45 WHEN 7 THEN 0 WHEN 8 THEN 1 WHEN 11 THEN 2 WHEN 12 THEN 3 WHEN 13 THEN 4 WHEN 17 THEN 5 WHEN 19 THEN 6 WHEN 20 THEN 7 WHEN 21 THEN 8 WHEN 22 THEN 9 WHEN 24 THEN 10 WHEN 26 THEN 11 WHEN 27 THEN 12 WHEN 32 THEN 13 WHEN 33 THEN 14 WHEN 34 THEN 2 WHEN 35 THEN 4 WHEN 37 THEN 5 ELSE 15 END AS label FROM pts")
def street_labels(spark, d):
    return points(spark, d).select("pid", catalog.KITTI360.label(F.pmod("pid", F.lit(45))).alias("label"))


@query("SELECT lab AS label, round(1 / (sqrt(n) + 1) / sum(1 / (sqrt(n) + 1)) OVER (), 6) AS weight FROM (SELECT lab, count(*) AS n FROM pts WHERE lab < 4 GROUP BY 1)")
def class_weights(spark, d):
    return metrics.class_weights(points(spark, d), CLASSES, "lab")


@query("SELECT round(sum((1 + lab) * (abs(x - z) + abs(y - r))) / sum(1 + lab), 6) AS error FROM pts")
def weighted_error_l1(spark, d):
    return metrics.weighted_error(points(spark, d).withColumn("w", F.col("lab") + 1), ["x", "y"], ["z", "r"], 1, "w")


@query("SELECT round(avg((x - z) * (x - z) + (y - r) * (y - r)), 4) AS error FROM pts")
def weighted_error_l2(spark, d):
    return metrics.weighted_error(points(spark, d), ["x", "y"], ["z", "r"], 2).select(F.round("error", 4).alias("error"))


@query("SELECT round(avg(abs(x - z) + abs(y - r)), 4) AS error FROM pts")
def error_l1(spark, d):
    return metrics.weighted_error(points(spark, d), ["x", "y"], ["z", "r"], 1).select(F.round("error", 4).alias("error"))


@query("SELECT round(sum((1 + lab) * ((x - z) * (x - z) + (y - r) * (y - r))) / sum(1 + lab), 4) AS error FROM pts")
def error_l2_by_label(spark, d):
    return metrics.weighted_error(points(spark, d).withColumn("w", F.col("lab") + 1), ["x", "y"], ["z", "r"], 2, "w").select(F.round("error", 4).alias("error"))


# --- overlaps


@query("SELECT cluster, obj, cnt, y FROM ov", "ov")
def overlap_build(spark, d):
    return overlap_table(spark, d)


@query("SELECT CAST(trunc(cluster / 1000) AS BIGINT) AS cluster, obj, CAST(sum(cnt) AS BIGINT) AS cnt, min(y) AS y FROM ov GROUP BY 1, 2", "ov")
def overlap_merge(spark, d):
    t = overlap_table(spark, d)
    parents = t.select("cluster").distinct().withColumn("super_index", (F.col("cluster") / 1000).cast("long"))
    return instances.merge_overlaps(t, parents)


@query("SELECT cluster, obj, cnt, y FROM maj", "maj")
def overlap_major(spark, d):
    return instances.major(overlap_table(spark, d))


@query(
    """WITH n AS (SELECT cluster, sum(cnt) AS n FROM ov GROUP BY 1), r AS (SELECT bool_or(y >= 4 AND 2 * cnt <= n) AS move FROM maj JOIN n USING (cluster)),
    v AS (SELECT * FROM ov WHERE y < 4 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, obj) = 1)
    SELECT m.cluster, CASE WHEN move AND m.y >= 4 AND v.obj IS NOT NULL THEN v.obj ELSE m.obj END AS obj, CASE WHEN move AND m.y >= 4 AND v.obj IS NOT NULL THEN v.cnt ELSE m.cnt END AS cnt,
    CASE WHEN move AND m.y >= 4 AND v.obj IS NOT NULL THEN v.y ELSE m.y END AS y FROM maj m LEFT JOIN v ON v.cluster = m.cluster, r""",
    "maj",
)
def overlap_major_void(spark, d):
    return instances.major(overlap_table(spark, d), CLASSES)


@query("SELECT cluster, obj, cnt, round(cnt / (sum(cnt) OVER (PARTITION BY cluster) + sum(cnt) OVER (PARTITION BY obj) - cnt), 6) AS iou FROM ov", "ov")
def pair_iou(spark, d):
    return instances.pair_iou(overlap_table(spark, d)).select("cluster", "obj", "cnt", "iou")


@query("SELECT cluster, obj, cnt, y, CAST(cropped AS BIGINT) AS cropped FROM clean", "clean")
def remove_void(spark, d):
    return instances.remove_void(predicted(spark, d).select("cluster", "obj", "cnt", "y"), CLASSES)


@query("SELECT cluster, obj, round(iou, 6) AS iou FROM iou", "iou")
def pair_iou_void_aware(spark, d):
    return instances.pair_iou(instances.remove_void(predicted(spark, d), CLASSES)).select("cluster", "obj", "iou")


@query(
    """WITH w AS (SELECT cluster, obj, cnt / (sum(cnt) OVER (PARTITION BY cluster) + sum(cnt) OVER (PARTITION BY obj) - cnt) AS w FROM ov)
    SELECT obj, round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy, round(sum(w * z) / sum(w), 6) AS cz FROM w JOIN snode ON id = cluster GROUP BY 1""",
    "ov snode",
)
def obj_centroid(spark, d):
    at = segment_nodes(spark, d).select(F.col("id").alias("cluster"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    return instances.object_centroids(overlap_table(spark, d), at)


@query("SELECT cluster, y AS label, CAST(sum(cnt) AS BIGINT) AS n FROM ov GROUP BY 1, 2", "ov")
def target_histogram(spark, d):
    return instances.target_histogram(overlap_table(spark, d), CLASSES)


_PART = "p AS (SELECT cluster, obj, cnt / sum(cnt) OVER (PARTITION BY cluster) AS part FROM ov)"


@query(
    f"""WITH {_PART}, e AS (SELECT s, t, a.obj AS so, b.obj AS bo FROM sedge JOIN maj a ON a.cluster = s JOIN maj b ON b.cluster = t)
    SELECT s, t, round(0.5 * (coalesce(u.part, 0) + coalesce(v.part, 0)), 6) AS affinity FROM e LEFT JOIN p u ON u.cluster = s AND u.obj = bo LEFT JOIN p v ON v.cluster = t AND v.obj = so""",
    "maj sedge",
)
def edge_affinity_smooth(spark, d):
    return instances.edge_affinity(segment_edges(spark, d), overlap_table(spark, d))


@query("SELECT s, t, CAST(a.obj = b.obj AS DOUBLE) AS affinity FROM sedge JOIN maj a ON a.cluster = s JOIN maj b ON b.cluster = t", "maj sedge")
def edge_affinity_hard(spark, d):
    return instances.edge_affinity(segment_edges(spark, d), overlap_table(spark, d), smooth=False)


_VOID = "v AS (SELECT cluster AS id, 2 * sum(CASE WHEN y >= 4 THEN cnt ELSE 0 END) > sum(cnt) AS void FROM ov GROUP BY 1)"


@query(f"WITH {_VOID} SELECT s, t, a.void AND b.void AS void FROM sedge JOIN v a ON a.id = s JOIN v b ON b.id = t", "ov sedge")
def void_edges(spark, d):
    hist = instances.target_histogram(overlap_table(spark, d), CLASSES)
    void = hierarchy.void_nodes(hist, ["cluster"], CLASSES).withColumnRenamed("cluster", "id")
    return instances.void_edges(segment_edges(spark, d).select("s", "t"), void)


@query(
    f"""WITH {_PART}, {_VOID}, e AS (SELECT s, t, a.obj AS so, b.obj AS bo, a.y AS sy, b.y AS ty FROM sedge JOIN maj a ON a.cluster = s JOIN maj b ON b.cluster = t JOIN v m ON m.id = s JOIN v n ON n.id = t WHERE NOT (m.void AND n.void))
    SELECT s, t, round(0.5 * (coalesce(u.part, 0) + coalesce(w.part, 0)), 6) AS affinity, sy = ty AS same_class, so = bo AS same_obj FROM e LEFT JOIN p u ON u.cluster = s AND u.obj = bo LEFT JOIN p w ON w.cluster = t AND w.obj = so""",
    "maj sedge",
)
def sanitized_affinities(spark, d):
    return instances.sanitized_affinities(segment_edges(spark, d), overlap_table(spark, d), CLASSES)


@query("SELECT count(DISTINCT cluster) AS clusters, count(*) AS overlaps, count(DISTINCT obj) AS objects FROM ov", "ov")
def overlap_summary(spark, d):
    return instances.clusters_summary(overlap_table(spark, d))


@query("SELECT cluster, obj, cnt, y, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, obj) AS rank FROM ov) WHERE rank <= 3", "ov")
def overlap_top(spark, d):
    return instances.top_overlaps(overlap_table(spark, d), 3)


@query("SELECT pid, lab AS y, CASE WHEN lab IN (0, 4) THEN min(obj) OVER (PARTITION BY lab) ELSE obj END AS obj FROM pts")
def sanitized_labels(spark, d):
    return instances.merge_stuff(points(spark, d).select("pid", F.col("lab").alias("y"), "obj"), [0], CLASSES).select("pid", "y", "obj")


# --- panoptic quality and average precision

_PQ = """, c AS (SELECT unnest([0, 1, 2, 3]) AS class),
np AS (SELECT pred_y AS class, count(DISTINCT cluster) AS n_pred FROM {t} GROUP BY 1), nt AS (SELECT y AS class, count(DISTINCT obj) AS n_target FROM {t} GROUP BY 1),
h AS (SELECT y AS class, count(*) FILTER (WHERE iou > 0.5) AS tp, coalesce(sum(iou) FILTER (WHERE iou > 0.5), 0) AS si, sum(iou) AS anyiou FROM {t} WHERE y = pred_y GROUP BY 1),
q AS (SELECT CAST(class AS INTEGER) AS class, coalesce(n_pred, 0) AS n_pred, coalesce(n_target, 0) AS n_target, coalesce(tp, 0) AS tp, coalesce(si, 0) AS si, coalesce(anyiou, 0) AS anyiou
FROM c LEFT JOIN np USING (class) LEFT JOIN nt USING (class) LEFT JOIN h USING (class) WHERE n_pred IS NOT NULL OR n_target IS NOT NULL),
f AS (SELECT *, CASE WHEN tp > 0 THEN si / tp ELSE 0 END AS sq, 2 * tp / (n_pred + n_target) AS rq FROM q)
SELECT class, tp, n_pred - tp AS fp, n_target - tp AS fn, round(sq, 6) AS sq, round(rq, 6) AS rq, round(sq * rq, 6) AS pq,
round(CASE WHEN class = 0 THEN anyiou / greatest(n_target, 1) ELSE sq * rq END, 6) AS pq_modified FROM f"""


@query("WITH z AS (SELECT 1)" + _PQ.format(t="iou"), "iou")
def panoptic_quality(spark, d):
    return metrics.panoptic_quality(predicted(spark, d), CLASSES, [0])


_AP = """WITH t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold), pr AS (SELECT DISTINCT cluster, pred_y, score FROM clean),
hit AS (SELECT threshold, cluster FROM (SELECT * FROM iou, t WHERE y = pred_y AND (iou > threshold OR iou = threshold AND threshold > 0.5)) QUALIFY row_number() OVER (PARTITION BY threshold, obj ORDER BY score DESC, cluster) = 1),
nt AS (SELECT y AS class, count(DISTINCT obj) AS n_target FROM clean GROUP BY 1),
r AS (SELECT pred_y AS class, t.threshold, pr.cluster, score, CASE WHEN hit.cluster IS NULL THEN 0 ELSE 1 END AS hit FROM pr JOIN t ON true LEFT JOIN (SELECT DISTINCT threshold AS th, cluster FROM hit) hit ON hit.th = t.threshold AND hit.cluster = pr.cluster),
k AS (SELECT class, threshold, n_target, sum(hit) OVER w / n_target AS recall, sum(hit) OVER w / count(*) OVER w AS precision FROM (SELECT r.class, r.threshold, r.cluster AS cl, r.score, r.hit, n_target FROM r JOIN nt ON nt.class = r.class)
WINDOW w AS (PARTITION BY class, threshold ORDER BY score DESC, cl ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT class, threshold, sum(p) / 101 AS ap FROM (SELECT class, threshold, l, max(precision) AS p FROM k, (SELECT unnest(range(101)) AS l) WHERE recall * 100 + 1e-9 >= l GROUP BY 1, 2, 3) GROUP BY 1, 2),
rc AS (SELECT class, threshold, max(recall) AS recall FROM k GROUP BY 1, 2),
o AS (SELECT nt.class, t.threshold, n_target, coalesce(ap, 0) AS ap, coalesce(recall, 0) AS recall FROM nt JOIN t ON true LEFT JOIN ap ON ap.class = nt.class AND ap.threshold = t.threshold LEFT JOIN rc ON rc.class = nt.class AND rc.threshold = t.threshold)"""


@query(f"{_AP} SELECT class, threshold, n_target, round(ap, 6) AS ap, round(recall, 6) AS recall FROM o", "iou")
def average_precision(spark, d):
    return metrics.average_precision(predicted(spark, d), CLASSES)


@query(f"{_AP} SELECT round(avg(ap), 6) AS map, round(avg(ap) FILTER (WHERE threshold = 0.5), 6) AS map_50, round(avg(ap) FILTER (WHERE threshold = 0.75), 6) AS map_75, round(avg(recall), 6) AS mar FROM o", "iou")
def mean_average_precision(spark, d):
    return metrics.summarize_ap(metrics.average_precision(predicted(spark, d), CLASSES))


_ORACLE = f"""best AS (SELECT * FROM ovp0 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, obj) = 1),
valid AS (SELECT * FROM ovp0 WHERE y < {CLASSES} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, obj) = 1),
size AS (SELECT cluster, sum(cnt) AS n FROM ovp0 GROUP BY 1),
rule AS (SELECT bool_or(y >= {CLASSES} AND 2 * cnt <= n) AS move FROM best JOIN size USING (cluster)),
m AS (SELECT b.cluster, CASE WHEN move AND b.y >= {CLASSES} AND v.obj IS NOT NULL THEN v.obj ELSE b.obj END AS super, CASE WHEN move AND b.y >= {CLASSES} AND v.obj IS NOT NULL THEN v.y ELSE b.y END AS pred_y
FROM best b LEFT JOIN valid v ON v.cluster = b.cluster, rule),
lb AS (SELECT super AS cluster, min(pred_y) AS pred_y FROM m GROUP BY 1),
tb AS (SELECT cluster, obj, cnt, y, pred_y FROM (SELECT super AS cluster, obj, sum(cnt) AS cnt, min(y) AS y FROM ovp0 JOIN m USING (cluster) GROUP BY 1, 2) JOIN lb USING (cluster)),
gn AS (SELECT *, 2 * sum(CASE WHEN y >= {CLASSES} THEN cnt ELSE 0 END) OVER (PARTITION BY cluster) > sum(cnt) OVER (PARTITION BY cluster) AS gone FROM tb),
cr AS (SELECT *, sum(CASE WHEN gone THEN cnt ELSE 0 END) OVER (PARTITION BY obj) AS cropped FROM gn),
io AS (SELECT *, cnt / (sum(cnt) OVER (PARTITION BY cluster) + sum(cnt) OVER (PARTITION BY obj) + cropped - cnt) AS iou FROM cr WHERE NOT gone AND y < {CLASSES}),
np AS (SELECT pred_y AS class, count(DISTINCT cluster) AS n_pred FROM io GROUP BY 1), nt AS (SELECT y AS class, count(DISTINCT obj) AS n_target FROM io GROUP BY 1),
h AS (SELECT y AS class, count(*) FILTER (WHERE iou > 0.5) AS tp, coalesce(sum(iou) FILTER (WHERE iou > 0.5), 0) AS si FROM io WHERE y = pred_y GROUP BY 1),
q AS (SELECT CAST(class AS INTEGER) AS class, coalesce(n_pred, 0) AS n_pred, coalesce(n_target, 0) AS n_target, coalesce(tp, 0) AS tp, coalesce(si, 0) AS si FROM np FULL JOIN nt USING (class) LEFT JOIN h USING (class)),
f AS (SELECT *, CASE WHEN tp > 0 THEN si / tp ELSE 0 END AS sq, 2 * tp / (n_pred + n_target) AS rq FROM q)"""


@query(f"WITH {_ORACLE} SELECT class, tp, n_pred - tp AS fp, n_target - tp AS fn, round(sq, 6) AS sq, round(rq, 6) AS rq, round(sq * rq, 6) AS pq, round(sq * rq, 6) AS pq_modified FROM f", "ovp0")
def oracle_panoptic(spark, d):
    return metrics.panoptic_quality(instances.oracle_clusters(predicted(spark, d).select("cluster", "obj", "cnt", "y"), CLASSES), CLASSES)


@query("SELECT s, t, round(d, 6) AS d FROM sedge", "sedge")
def instance_graph_edges(spark, d):
    return graph.trimmed(segment_edges(spark, d), {"d": "min"})


@query("SELECT super_index AS cluster, lab AS label FROM (SELECT super_index, lab, count(*) AS n FROM seg GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY super_index ORDER BY n DESC, lab) = 1", "seg")
def dominant_labels(spark, d):
    return voxels.majority(segments(spark, d), ["super_index"], "lab").select(F.col("super_index").alias("cluster"), F.col("lab").alias("label"))


# --- clouds put together

_IDS = {"points": {"pid": "points", "super_index": "segments"}, "segments": {"id": "segments", "children": "points"}}


def _clouds(spark, d):
    """Three clouds: the points of each residue of pid by 3, and their segments with lists of children."""
    out = []
    for k in range(3):
        p = segments(spark, d).where(F.pmod("pid", F.lit(3)) == k).select("pid", "super_index", "z")
        lists = p.groupBy(F.col("super_index").alias("id")).agg(F.sort_array(F.collect_list("pid")).alias("children"))
        out.append({"points": p, "segments": lists})
    return out


_COLLATED = """WITH o AS (SELECT pid % 3 AS b, pid, super_index FROM seg), m AS (SELECT b, max(pid) + 1 AS np, max(super_index) + 1 AS ns FROM o GROUP BY 1),
base AS (SELECT b, coalesce(sum(np) OVER w, 0) AS bp, coalesce(sum(ns) OVER w, 0) AS bs FROM m WINDOW w AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(b AS INTEGER) AS batch, CAST(pid + bp AS BIGINT) AS pid, CAST(super_index + bs AS BIGINT) AS super_index FROM o JOIN base USING (b)"""


@query(_COLLATED, "seg")
def collated_points(spark, d):
    return collate.collated(_clouds(spark, d), _IDS)["points"].select("batch", "pid", "super_index")


@query(_COLLATED.replace("AS pid,", "AS child,").replace("AS super_index FROM o JOIN", "AS id FROM o JOIN"), "seg")
def collated_children(spark, d):
    out = collate.collated(_clouds(spark, d), _IDS)["segments"]
    return out.select("batch", F.explode("children").alias("child"), "id")


@query("SELECT pid, super_index, round(z, 6) AS z FROM seg WHERE pid % 3 = 1", "seg")
def separated_cloud(spark, d):
    tables = collate.collated(_clouds(spark, d), _IDS)
    return collate.separated(tables, 1, _IDS)["points"].select("pid", "super_index", "z")
