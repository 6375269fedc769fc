"""Voxels, grids, hierarchies, projections, ragged lists, features, sampling and tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import eigen, features
from ..functions.expr import argmax
from ..operators import columns, graph, hierarchy, ids, neighbors, ragged, sampling, voxels
from ..sources import catalog, clouds
from . import pipeline as pipelines
from .fixtures import RADIUS, cloud, edges, neighbours, nodes, points, query, segment_edges, segment_nodes, segments, table

CELLS = ["cx", "cy", "cz"]
SIZE = (10.0, 10.0, 10.0)


def _voxels(spark, d):
    return voxels.with_cells(points(spark, d), SIZE)


def _histogram(spark, d):
    return voxels.histogram(_voxels(spark, d), CELLS, "lab")


# --- voxels and grids


@query("SELECT cx, cy, cz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM vox GROUP BY 1, 2, 3", "vox")
def voxel_mean(spark, d):
    return voxels.grid_sampling(points(spark, d), SIZE)


@query(
    """SELECT cx, cy, cz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z,
    arg_max(lab, pid) AS lab, arg_max(obj, pid) AS obj FROM vox GROUP BY 1, 2, 3""",
    "vox",
)
def voxel_last(spark, d):
    return voxels.grid_sampling(points(spark, d), SIZE, last=["lab", "obj"])


@query("SELECT cx, cy, cz, lab, count(*) AS n FROM vox GROUP BY ALL", "vox")
def voxel_hist(spark, d):
    return _histogram(spark, d)


@query(
    "SELECT cx, cy, cz, lab FROM (SELECT cx, cy, cz, lab, count(*) AS n FROM vox GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cx, cy, cz ORDER BY n DESC, lab) = 1",
    "vox",
)
def majority_vote(spark, d):
    return voxels.majority(_voxels(spark, d), CELLS, "lab")


@query("SELECT cx, cy, cz, lab FROM vox", "vox")
def hist_to_atomic(spark, d):
    return voxels.histogram_to_atomic(_histogram(spark, d), "lab")


@query(
    "SELECT cx, cy, cz, " + ", ".join(f"count(*) FILTER (WHERE lab = {i}) AS h{i}" for i in range(5)) + " FROM vox GROUP BY 1, 2, 3",
    "vox",
)
def hist_dense(spark, d):
    out = voxels.histogram_array(_histogram(spark, d), CELLS, "lab", 5)
    return out.select(*CELLS, *[F.get("hist", F.lit(i)).alias(f"h{i}") for i in range(5)])


@query(
    """SELECT lab, n, CAST(ceil(sum(n) OVER (ORDER BY lab) / 1000) - 1 AS BIGINT) AS chunk FROM (SELECT lab, count(*) AS n FROM pts GROUP BY 1)"""
)
def histogram_chunks(spark, d):
    return voxels.split_histogram(voxels.histogram(points(spark, d), [], "lab"), "lab", 1000)


@query("SELECT pid, dense_rank() OVER (ORDER BY trunc(x / 20), trunc(y / 20)) - 1 AS part FROM pts")
def xy_partition(spark, d):
    return voxels.xy_partition(points(spark, d), 20.0).select("pid", "part")


@query("SELECT pid, dense_rank() OVER (ORDER BY trunc(x / 20), trunc(y / 20), trunc(z / 20)) - 1 AS part FROM pts")
def xyz_partition(spark, d):
    return voxels.xyz_partition(points(spark, d), 20.0).select("pid", "part")


@query(
    """SELECT 1 AS level, id, super_index, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n_children FROM h1
    UNION ALL SELECT 2, id, NULL, round(x, 6), round(y, 6), round(z, 6), n_children FROM h2""",
    "h2",
)
def grid_hierarchy(spark, d):
    h = cloud(spark, d)
    cols = ("level", "id", "super_index", "x", "y", "z", "n_children")
    low, top = h.nodes[1].withColumn("level", F.lit(1)), h.nodes[2].withColumn("level", F.lit(2)).withColumn("super_index", F.lit(None).cast("long"))
    return low.select(*cols).union(top.select(*cols))


@query("SELECT h1.super_index AS id, count(*) AS node_size FROM h0 JOIN h1 ON h0.super_index = h1.id GROUP BY 1", "h1")
def node_size(spark, d):
    return cloud(spark, d).sub_size(0, 2)


@query("SELECT pid AS id, h1.super_index AS super_index FROM h0 JOIN h1 ON h0.super_index = h1.id", "h1")
def super_index_chain(spark, d):
    return cloud(spark, d).super_index(0, 2)


@query("SELECT 0 AS level, count(*) AS n FROM h0 UNION ALL SELECT 1, count(*) FROM h1 UNION ALL SELECT 2, count(*) FROM h2", "h2")
def level_sizes(spark, d):
    return cloud(spark, d).level_sizes()


@query(
    """WITH a AS (SELECT * FROM h1 WHERE id % 2 = 0) SELECT 1 AS level, id FROM a UNION ALL SELECT 0, pid FROM h0 WHERE super_index IN (SELECT id FROM a)
    UNION ALL SELECT 2, id FROM h2 WHERE id IN (SELECT super_index FROM a)""",
    "h2",
)
def select_cascade(spark, d):
    h = cloud(spark, d)
    h = h.select(1, h.nodes[1].where("id % 2 = 0"))
    parts = [df.select(F.lit(i).alias("level"), "id") for i, df in h.nodes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT pid AS id, super_index FROM h0 WHERE super_index IN (SELECT id FROM h1 WHERE n_children > 20)", "h1")
def select_by_key(spark, d):
    h = cloud(spark, d).map_nodes(lambda df: df.withColumn("large", F.col("n_children") > 20), 1)
    return h.select_by_key(1, "large").nodes[0].select("id", "super_index")


@query(
    """WITH k AS (SELECT pid, dense_rank() OVER (ORDER BY pid) - 1 AS new_id FROM pts WHERE lab < 3)
    SELECT a.new_id AS s, b.new_id AS t FROM adj JOIN k a ON a.pid = adj.s JOIN k b ON b.pid = adj.t""",
    "adj",
)
def reindex_dense(spark, d):
    _, e = hierarchy.reindexed(nodes(spark, d).where("lab < 3"), edges(spark, d))
    return e.select(F.col("new_s").alias("s"), F.col("new_t").alias("t"))


@query("SELECT pid AS id, h1.super_index * 10 AS pred FROM h0 JOIN h1 ON h0.super_index = h1.id", "h1")
def full_resolution_pred(spark, d):
    h = cloud(spark, d)
    preds = h.nodes[2].select("id", (F.col("id") * 10).alias("pred"))
    return hierarchy.expand_predictions(preds, h.nodes[1], h.nodes[0])


@query("SELECT super_index, 2 * count(*) FILTER (WHERE lab >= 4) > count(*) AS void FROM seg GROUP BY 1", "seg")
def void_mask(spark, d):
    return hierarchy.void_nodes(voxels.histogram(segments(spark, d), ["super_index"], "lab"), ["super_index"], 4, "lab")


@query("SELECT n AS size, count(*) AS n FROM (SELECT count(*) AS n FROM h0 GROUP BY super_index) GROUP BY 1", "h0")
def size_histogram(spark, d):
    return hierarchy.size_histogram(cloud(spark, d).sub_size(0, 1))


@query(
    """WITH b AS (SELECT i, j FROM near WHERE i % 4 <> 0 AND j % 4 = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1)
    SELECT p.pid, CAST(CASE q.lab WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 11 WHEN 3 THEN 12 END AS INTEGER) AS label FROM pts p LEFT JOIN b ON b.i = p.pid LEFT JOIN pts q ON q.pid = b.j WHERE p.pid % 4 <> 0""",
    "near",
)
def submission(spark, d):
    p = points(spark, d)
    return hierarchy.submission(p.where("pid % 4 <> 0"), p.where("pid % 4 = 0").withColumnRenamed("lab", "pred"), RADIUS, {0: 7, 1: 8, 2: 11, 3: 12})


@query("SELECT pid, CASE WHEN pid % 4 = 2 THEN 'test' ELSE 'train' END AS split FROM pts")
def fold_split(spark, d):
    return points(spark, d).select("pid", catalog.fold_split(F.pmod("pid", F.lit(4)), 2).alias("split"))


@query("SELECT pid, lab FROM pts WHERE lab IN (0, 3)")
def split_clouds(spark, d):
    c = catalog.Collection("demo", 4, (0,), {"train": ("3",), "val": ("0",), "test": ("1",)})
    rows = points(spark, d).withColumn("cloud_id", F.col("lab").cast("string"))
    return c.clouds(rows, "trainval").select("pid", "lab")


# --- projections


@query("SELECT pid, x / 1 AS f0, y AS f1, z AS f2 FROM pts")
def add_keys(spark, d):
    out = columns.add_keys(points(spark, d).select("pid", "x", "y", "z"), ["x", "y", "z"], "f")
    return out.select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(3)])


@query("SELECT pid, z AS f0, x AS f1 FROM pts")
def select_columns(spark, d):
    out = columns.add_keys(points(spark, d).select("pid", "x", "y", "z"), ["x", "y", "z"], "f")
    out = columns.select_columns(out, "f", [2, 0])
    return out.select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(2)])


@query("SELECT pid, x, y FROM pts")
def remove_keys(spark, d):
    return columns.remove_keys(points(spark, d), ["z", "lab", "obj", "r", "g", "b"])


@query("SELECT pid, round(r / 255.0, 6) AS r, round(g / 255.0, 6) AS g, CAST(lab AS BIGINT) AS lab FROM pts")
def cast_columns(spark, d):
    return columns.cast_columns(points(spark, d).select("pid", "r", "g", "lab"), fp="double")


@query("SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS node_id FROM pts")
def node_index(spark, d):
    return columns.save_node_index(points(spark, d).select("pid"), "pid")


@query("SELECT pid, x AS f0, round((SELECT avg(y) FROM pts), 6) AS f1 FROM pts")
def dropout_columns(spark, d):
    out = columns.add_keys(points(spark, d).select("pid", "x", "y"), ["x", "y"], "f")
    out = columns.dropout_columns(out, "f", [1], to_mean=True)
    return out.select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(2)])


def _uniform(seed, *keys):
    """SQL of `noise.uniform`."""
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def _normal(seed, *keys):
    return f"(sqrt(-2 * ln({_uniform(seed, chr(39) + 'r' + chr(39), *keys)})) * cos(2 * pi() * {_uniform(seed, chr(39) + 'a' + chr(39), *keys)}))"


@query(f"SELECT pid, round(x + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, {_normal(3, 'pid', chr(39) + 'x' + chr(39))} * 0.1::DOUBLE)), 6) AS x, round(y + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, {_normal(3, 'pid', chr(39) + 'y' + chr(39))} * 0.1::DOUBLE)), 6) AS y FROM pts")
def jittered(spark, d):
    return columns.jitter(points(spark, d).select("pid", "x", "y"), ["x", "y"], 0.1, 0.2, 3)


@query(
    f"""SELECT 0 AS level, pid AS id, round(z + {_normal(7, 'pid', chr(39) + 'z' + chr(39))} * 0.5::DOUBLE, 6) AS z FROM pts
    UNION ALL SELECT 1, id, round(z, 6) FROM snode""",
    "snode",
)
def jittered_levels(spark, d):
    levels = [nodes(spark, d).select("id", "z"), segment_nodes(spark, d).select("id", "z")]
    low, high = columns.jitter_levels(levels, ["z", "absent"], [0.5, 0.0], 0, 7)
    return low.select(F.lit(0).alias("level"), "id", "z").union(high.select(F.lit(1).alias("level"), "id", "z"))


@query(f"SELECT pid, CASE WHEN {_uniform(5, 'pid')} < 0.3 THEN 0 ELSE x END AS f0, round(CASE WHEN {_uniform(5, 'pid')} < 0.3 THEN 0 ELSE y END, 6) AS f1 FROM pts")
def dropped_rows(spark, d):
    out = columns.dropout_rows(columns.add_keys(points(spark, d).select("pid", "x", "y"), ["x", "y"], "f"), "f", 0.3, 5)
    return out.select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(2)])


@query(f"SELECT pid, round(CASE WHEN {_uniform(6, 'pid')} < 0.3 THEN avg(x) OVER () ELSE x END, 6) AS f0, round(CASE WHEN {_uniform(6, 'pid')} < 0.3 THEN avg(z) OVER () ELSE z END, 6) AS f1 FROM pts")
def dropped_rows_to_mean(spark, d):
    out = columns.dropout_rows(columns.add_keys(points(spark, d).select("pid", "x", "z"), ["x", "z"], "f"), "f", 0.3, 6, to_mean=True)
    return out.select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(2)])


@query("SELECT count(*) AS n FROM pts")
def shuffled_rows(spark, d):
    return columns.shuffled(points(spark, d)).agg(F.count(F.lit(1)).alias("n"))


# --- ragged lists and batches


@query("SELECT super_index, count(*) AS size FROM seg GROUP BY 1", "seg")
def csr_sizes(spark, d):
    return ragged.sizes(segments(spark, d), "super_index")


@query("SELECT super_index, string_agg(CAST(lab AS VARCHAR), ',' ORDER BY pid) AS labs FROM seg GROUP BY 1", "seg")
def csr_lists(spark, d):
    out = ragged.to_lists(segments(spark, d), "super_index", "pid", ["lab"])
    return out.select("super_index", F.array_join(F.transform("values", lambda v: v["lab"].cast("string")), ",").alias("labs"))


@query("SELECT super_index, CAST(row_number() OVER (PARTITION BY super_index ORDER BY pid) - 1 AS INTEGER) AS pos, pid FROM seg", "seg")
def csr_explode(spark, d):
    return ragged.from_lists(ragged.to_lists(segments(spark, d), "super_index", "pid", ["pid"]), "super_index")


@query("SELECT super_index, size, coalesce(sum(size) OVER (ORDER BY super_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT super_index, count(*) AS size FROM seg GROUP BY 1)", "seg")
def csr_pointers(spark, d):
    return ragged.pointers(ragged.sizes(segments(spark, d), "super_index"), "super_index")


@query("SELECT super_index, pid, pos AS new_group FROM seg JOIN (SELECT super_index, super_index + k AS pos FROM (SELECT DISTINCT super_index FROM seg WHERE super_index % 3 = 0), (SELECT unnest([0, 7]) AS k)) USING (super_index)", "seg")
def csr_take(spark, d):
    s = segments(spark, d)
    wanted = s.where("super_index % 3 = 0").select("super_index").distinct()
    wanted = wanted.select("super_index", F.explode(F.array(F.lit(0), F.lit(7))).alias("k")).select("super_index", (F.col("super_index") + F.col("k")).alias("pos"))
    return ragged.take(s.select("super_index", "pid"), "super_index", wanted)


@query("SELECT obj, coalesce(n, 0) AS n FROM (SELECT unnest(range(60)) AS obj) LEFT JOIN (SELECT obj, count(*) AS n FROM pts GROUP BY 1) USING (obj)")
def csr_insert_empty(spark, d):
    out = ragged.with_empty_groups(ragged.to_lists(points(spark, d), "obj", "pid", ["pid"]), "obj", 60)
    return out.select("obj", F.size("values").cast("long").alias("n"))


@query("SELECT pid AS id, super_index FROM seg", "seg")
def cluster_invert(spark, d):
    rows = segments(spark, d).groupBy("super_index").agg(F.collect_list("pid").alias("sub"))
    return ragged.inverted(rows, "super_index", "sub")


@query(
    """SELECT CAST(pid % 2 AS INTEGER) AS batch, pid, obj + CASE WHEN pid % 2 = 1 THEN (SELECT max(obj) + 1 FROM pts WHERE pid % 2 = 0) ELSE 0 END AS obj FROM pts"""
)
def batch_union(spark, d):
    p = points(spark, d).select("pid", "obj")
    parts = [p.where(f"pid % 2 = {i}") for i in range(2)]
    return ragged.batch_union(parts, ["obj"])


@query("SELECT pid, obj - (SELECT min(obj) FROM pts WHERE pid % 2 = 1) AS obj FROM pts WHERE pid % 2 = 1")
def batch_part(spark, d):
    p = points(spark, d).select("pid", "obj")
    return ragged.batch_part(ragged.batch_union([p.where(f"pid % 2 = {i}") for i in range(2)], ["obj"]), 1, ["obj"])


@query("SELECT obj, 'a,b' AS splits FROM (SELECT DISTINCT obj FROM pts WHERE obj < 25 INTERSECT SELECT DISTINCT obj FROM pts WHERE obj >= 20)")
def split_disjoint(spark, d):
    p = points(spark, d)
    out = ragged.disjoint({"a": p.where("obj < 25"), "b": p.where("obj >= 20")}, "obj")
    return out.select("obj", F.array_join("splits", ",").alias("splits"))


@query("SELECT cx, cy, lab AS col, count(*) AS val FROM vox GROUP BY ALL", "vox")
def dense_to_csr(spark, d):
    rows = _voxels(spark, d)
    dense = voxels.histogram_array(voxels.histogram(rows, ["cx", "cy"], "lab"), ["cx", "cy"], "lab", 5)
    dense = dense.select(F.struct("cx", "cy").alias("id"), "hist")
    return ragged.dense_to_long(dense, "id", "hist").select("id.cx", "id.cy", "col", "val")


@query("SELECT super_index AS id, " + ", ".join(f"CAST(count(*) FILTER (WHERE lab = {i}) AS DOUBLE) AS v{i}" for i in range(5)) + " FROM seg GROUP BY 1", "seg")
def csr_to_dense(spark, d):
    rows = segments(spark, d).groupBy(F.col("super_index").alias("id"), F.col("lab").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    out = ragged.long_to_dense(rows, "id", 5)
    return out.select("id", *[F.get("values", F.lit(i)).alias(f"v{i}") for i in range(5)])


@query("SELECT pid, unnest(range(pid, pid + lab)) AS value FROM pts WHERE lab > 0")
def interleaved_ranges(spark, d):
    return ragged.interleaved_ranges(points(spark, d).select("pid", "lab"), "lab", "pid").select("pid", "value")


@query("SELECT pid, lab FROM (SELECT pid, lab, unnest(range(lab)) AS k FROM pts)")
def repeated_rows(spark, d):
    return ragged.repeated(points(spark, d).select("pid", "lab"), "lab")


@query("SELECT count(*) AS n, min(obj) = 0 AND max(obj) = count(DISTINCT obj) - 1 AS is_dense, count(DISTINCT obj) < count(*) AS has_duplicates, min(obj) = 0 AND max(obj) = count(*) - 1 AND count(DISTINCT obj) = count(*) AS is_permutation FROM pts")
def id_checks(spark, d):
    return ragged.id_checks(points(spark, d), "obj")


@query("SELECT obj, coalesce(bool_and(step >= 0), true) AS is_sorted FROM (SELECT obj, y - lag(y) OVER (PARTITION BY obj ORDER BY pid) AS step FROM pts) GROUP BY 1")
def sorted_groups(spark, d):
    return ragged.is_sorted(points(spark, d), "pid", "y", ["obj"])


@query(
    """SELECT obj, coalesce(bool_and(step >= 0), true) AS y_sorted, coalesce(bool_and(rise >= 0), true) AS rising_sorted FROM (
    SELECT obj, y - lag(y) OVER w AS step, pid // 7 - lag(pid // 7) OVER w AS rise FROM pts WINDOW w AS (PARTITION BY obj ORDER BY pid)) GROUP BY 1"""
)
def sorted_groups_all(spark, d):
    p = points(spark, d).withColumn("rising", F.floor(F.col("pid") / 7))
    y, rising = (ragged.is_sorted(p, "pid", c, ["obj"]).withColumnRenamed("is_sorted", f"{c}_sorted") for c in ("y", "rising"))
    return y.join(rising, "obj")


# --- colours and geometry


@query(
    """WITH c AS (SELECT pid, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM pts),
    m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM c)
    SELECT pid, round(CASE WHEN b = low THEN 60 * (g - r) / (top - low + 1e-10) + 60 WHEN r = low THEN 60 * (b - g) / (top - low + 1e-10) + 180
    ELSE 60 * (r - b) / (top - low + 1e-10) + 300 END, 6) AS h, round((top - low) / (top + 1e-10), 6) AS s, round(top, 6) AS v FROM m"""
)
def rgb2hsv(spark, d):
    p = features.scaled_rgb(points(spark, d))
    return p.select("pid", *features.rgb2hsv(F.col("r"), F.col("g"), F.col("b")))


@query(
    """WITH c AS (SELECT pid, """
    + ", ".join(f"100 * CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END AS {c}" for c in "rgb")
    + """ FROM pts), t AS (SELECT pid, round_even(r * 0.4124 + g * 0.3576 + b * 0.1805, 4) / 95.047 AS x, round_even(r * 0.2126 + g * 0.7152 + b * 0.0722, 4) / 100.0 AS y,
    round_even(r * 0.0193 + g * 0.1192 + b * 0.9505, 4) / 108.883 AS z FROM c), f AS (SELECT pid, """
    + ", ".join(f"CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0::DOUBLE / 3) ELSE 7.787 * {c} + 16.0::DOUBLE / 116 END AS {c}" for c in "xyz")
    + " FROM t) SELECT pid, round_even(116 * y - 16, 4) AS l, round_even(500 * (x - y), 4) AS a, round_even(200 * (y - z), 4) AS b FROM f"
)
def rgb2lab(spark, d):
    p = features.scaled_rgb(points(spark, d))
    return p.select("pid", *features.rgb2lab(F.col("r"), F.col("g"), F.col("b")))


@query("SELECT pid, round(0.5 * r + 0.5 * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 6) AS r FROM (SELECT pid, r / 255.0::DOUBLE AS r FROM pts)")
def auto_contrast(spark, d):
    return features.auto_contrast(features.scaled_rgb(points(spark, d))).select("pid", "r")


@query("SELECT pid, round((r / 255.0::DOUBLE - 0.5136457) / 0.18308958, 6) AS r FROM pts")
def color_normalized(spark, d):
    return features.color_normalized(features.scaled_rgb(points(spark, d))).select("pid", "r")


@query("SELECT pid, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM pts")
def hex_to_rgb(spark, d):
    return points(spark, d).select("pid", F.format_string("#%02x%02x%02x", "r", "g", "b").alias("h")).select("pid", *features.hex_to_rgb(F.col("h")))


@query("SELECT pid, round(r / 255.0::DOUBLE, 6) AS r, round(g / 255.0::DOUBLE, 6) AS g, round(b / 255.0::DOUBLE, 6) AS b FROM pts")
def scaled_rgb(spark, d):
    return features.scaled_rgb(points(spark, d)).select("pid", "r", "g", "b")


@query("SELECT pid, CAST(trunc(sqrt((r + 0.5::DOUBLE) / 256) * 255.0::DOUBLE) AS INTEGER) AS r FROM pts")
def byte_rgb(spark, d):
    shade = F.sqrt((F.col("r") + 0.5) / 256)
    return features.byte_rgb(points(spark, d).select("pid", shade.alias("r")), ("r",))


_SHADES = ", ".join(f"CAST(trunc(sqrt(({c} + 0.5::DOUBLE) / 256) * 255) AS INTEGER)" for c in "rgb")


@query(f"SELECT pid, format('rgb({{}},{{}},{{}})', {_SHADES}) AS colour, format('rgba({{}},{{}},{{}},{{}})', {_SHADES}, CASE WHEN lab = 1 THEN '0.50' ELSE '1.00' END) AS faint FROM pts")
def plot_colours(spark, d):
    c = [F.sqrt((F.col(c) + 0.5) / 256) for c in "rgb"]
    alpha = F.when(F.col("lab") == 1, 0.5).otherwise(1.0)
    return points(spark, d).select("pid", features.plot_colour(*c).alias("colour"), features.plot_colour(*c, alpha).alias("faint"))


@query("SELECT pid, CASE WHEN max(z) OVER w > min(z) OVER w THEN round((z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w), 6) ELSE 0 END AS z FROM pts WINDOW w AS (PARTITION BY obj)")
def min_max_by_object(spark, d):
    return features.min_max_normalized(points(spark, d).select("pid", "obj", "z"), ["z"], ["obj"]).select("pid", "z")


@query("SELECT pid, r, g, b, 0.0::DOUBLE AS r0, 0.0::DOUBLE AS g0, 0.0::DOUBLE AS b0 FROM pts")
def color_dropped(spark, d):
    p = points(spark, d).select("pid", "r", "g", "b", *[F.col(c).alias(f"{c}0") for c in "rgb"])
    return features.color_dropped(features.color_dropped(p, p=0.0), ("r0", "g0", "b0"), p=1.0)


@query("SELECT pid, round(CAST(y AS FLOAT)::DOUBLE, 6) AS high, round(CAST(y - CAST(y AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE * 1e6, 6) AS low_millionths, round(y, 6) AS back FROM pts")
def float_pairs(spark, d):
    high, low = features.float_pair(F.col("y"))
    rows = points(spark, d).select("pid", high.alias("high"), low.alias("low"))
    return rows.select("pid", F.col("high").cast("double").alias("high"), (F.col("low").cast("double") * 1e6).alias("low_millionths"), features.from_float_pair(F.col("high"), F.col("low")).alias("back"))


@query("SELECT pid, round((ln(z + 2) - sqrt(x)) / sqrt(2), 6) AS p0, round((ln(z + 2) + sqrt(x) - 2 * sin(y)) / sqrt(6), 6) AS p1 FROM pts")
def simplex_projection(spark, d):
    f = features.simplex_projection(F.array(F.log(F.col("z") + 2), F.sqrt("x"), F.sin("y")), 3, 2)
    return points(spark, d).select("pid", f.alias("f")).select("pid", *[F.get("f", F.lit(i)).alias(f"p{i}") for i in range(2)])


@query("SELECT pid FROM pts WHERE z / 100 < 0.3")
def low_verticality(spark, d):
    return features.low_verticality(points(spark, d).select("pid", (F.col("z") / 100).alias("verticality")), 0.3).select("pid")


@query("SELECT pid, pid % 3 AS by_graph, pid AS by_node, super_index * 3 + pid % 3 AS by_segment FROM seg", "seg")
def norm_index(spark, d):
    rows = segments(spark, d).select("pid", "super_index", F.pmod("pid", F.lit(3)).alias("batch"))
    for mode in ("graph", "node", "segment"):
        rows = columns.norm_index(rows, mode, "pid").withColumnRenamed("norm_index", f"by_{mode}")
    return rows.select("pid", "by_graph", "by_node", "by_segment")


@query("SELECT pid, list_position(l, list_max(l))::INTEGER - 1 AS label FROM (SELECT pid, [sin(x), cos(y), sin(z), cos(x + y)] AS l FROM pts)")
def semantic_label(spark, d):
    logits = F.array(F.sin("x"), F.cos("y"), F.sin("z"), F.cos(F.col("x") + F.col("y")))
    return points(spark, d).select("pid", argmax(logits).alias("label"))


@query(
    """WITH n AS (SELECT id, CAST(trunc(y / 100) AS BIGINT) AS obj, CAST(id % 4 AS INTEGER) AS label FROM h1)
    SELECT pid AS id, n.obj, label, 1::BIGINT AS cnt FROM h0 JOIN n ON n.id = h0.super_index""",
    "h1",
)
def full_resolution_panoptic(spark, d):
    h = cloud(spark, d)
    value = F.struct((F.col("y") / 100).cast("long").alias("obj"), F.pmod("id", F.lit(4)).cast("int").alias("label"))
    members = h.nodes[0].select(F.col("pid").alias("id"), "super_index")
    out = hierarchy.expand_predictions(h.nodes[1].select("id", value.alias("pred")), members)
    return out.select("id", "pred.obj", "pred.label", F.lit(1).cast("long").alias("cnt"))


@query(
    """SELECT (SELECT count(*) = count(DISTINCT (s, t)) AND count(*) FILTER (WHERE s >= t) = 0 FROM trim) AS edges_trimmed,
    (SELECT count(*) = count(DISTINCT (s, t)) AND count(*) FILTER (WHERE s >= t) = 0 FROM adj) AS neighbours_trimmed, true AS equal_to_itself, false AS equal_to_others""",
    "trim",
)
def table_checks(spark, d):
    e, p = edges(spark, d), points(spark, d).select("pid", "obj")
    t = graph.trimmed(e, {"d": "min"})
    row = (graph.is_trimmed(t), graph.is_trimmed(e), columns.tables_equal(p, p.select("obj", "pid")), columns.tables_equal(p, p.union(p.where("pid % 9 = 0"))))
    return spark.createDataFrame([row], "edges_trimmed boolean, neighbours_trimmed boolean, equal_to_itself boolean, equal_to_others boolean")


@query("SELECT pid, obj, dense_rank() OVER (ORDER BY obj) - 1 AS new_group, dense_rank() OVER (ORDER BY pid) - 1 AS new_value FROM pts")
def reindexed_groups(spark, d):
    return ragged.reindexed_lists(points(spark, d).select("pid", "obj"), "obj", "pid")


@query("SELECT i, round(count(*) / nullif(pow(max(d), 2), 0), 6) AS density FROM nbr GROUP BY 1", "nbr")
def density(spark, d):
    return features.density(neighbours(spark, d))


_COV = ", ".join(f"round(covar_pop({a}, {b}), 6) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(f"SELECT super_index, count(*) AS n, {_COV} FROM seg GROUP BY 1", "seg")
def covariance(spark, d):
    return features.covariances(segments(spark, d), ["super_index"])


_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
_NAMES = ("linearity", "planarity", "scattering", "length", "surface", "volume", "curvature", "verticality", "nx", "ny", "nz")


def _geometry(source, k_min):
    return eigen.nested(source, eigen.steps() + eigen.feature_steps(k_min)), ", ".join(f"round({c}, 6) + 0 AS {c}" for c in (*[f"c{p}" for p in _PAIRS], *_NAMES))


_SEG_FEATURES, _ROUNDED = _geometry("cv", 5)
_POINT_FEATURES, _ = _geometry("cv", 3)
_COVARIANCES = ", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in _PAIRS)


@query(
    f"""WITH cv AS (SELECT super_index, count(*) AS n, {_COVARIANCES} FROM seg GROUP BY 1), o AS (SELECT super_index, (ln(count(*) + 1) - ln(2)) / 10 AS log_size, avg(z) AS mean_z, coalesce(stddev_samp(z), 0) AS std_z FROM seg GROUP BY 1)
    SELECT super_index, n, {_ROUNDED}, round(log_size, 6) AS log_size, round(mean_z, 6) AS mean_z, round(std_z, 6) AS std_z FROM {_SEG_FEATURES} JOIN o USING (super_index)""",
    "seg",
)
def segment_geometry(spark, d):
    return features.segment_features(segments(spark, d), "super_index", ["z"])


@query(
    f"""WITH cv AS (SELECT i, count(*) AS n, {_COVARIANCES} FROM (SELECT i, j FROM nbr UNION ALL SELECT pid, pid FROM pts) JOIN pts ON pid = j GROUP BY 1)
    SELECT i, n, {_ROUNDED} FROM {_POINT_FEATURES}""",
    "nbr",
)
def point_geometry(spark, d):
    p = points(spark, d)
    return features.point_geometry(p, neighbours(spark, d), 3)


@query(
    """WITH u AS (SELECT super_index, x + 1 AS a, y - 200 AS b, z - 50 AS c FROM seg),
    n AS (SELECT super_index, a / sqrt(a*a+b*b+c*c) AS a, b / sqrt(a*a+b*b+c*c) AS b, c / sqrt(a*a+b*b+c*c) AS c FROM u),
    p AS (SELECT *, asin(greatest(-1, least(1, c))) AS phi FROM n),
    m AS (SELECT super_index, phi AS mphi, a AS ma, b AS mb, c AS mc, avg(phi) OVER (PARTITION BY super_index) AS mean FROM p QUALIFY row_number() OVER (PARTITION BY super_index ORDER BY phi, a, b, c) = 1),
    v AS (SELECT super_index, avg(sg * a) AS a, avg(sg * b) AS b, avg(sg * c) AS c FROM (SELECT p.*, CASE WHEN mean < pi() / 4 AND a * ma + b * mb + c * mc < 0 THEN -1 ELSE 1 END AS sg FROM p JOIN m USING (super_index)) GROUP BY 1)
    SELECT super_index, round(a * k, 6) AS nx, round(b * k, 6) AS ny, round(c * k, 6) AS nz FROM (SELECT *, CASE WHEN c < 0 THEN -1 ELSE 1 END / sqrt(a*a+b*b+c*c) AS k FROM v)""",
    "seg",
)
def mean_orientation(spark, d):
    rows = segments(spark, d).select("super_index", (F.col("x") + 1).alias("nx"), (F.col("y") - 200).alias("ny"), (F.col("z") - 50).alias("nz"))
    return features.mean_orientation(rows, "super_index")


@query("SELECT super_index, round(sum(z * n) / CASE WHEN sum(n) = 0 THEN 1 ELSE sum(n) END, 6) AS mean FROM (SELECT super_index, z, lab AS n FROM seg) GROUP BY 1", "seg")
def weighted_mean(spark, d):
    return features.weighted_mean(segments(spark, d), "super_index", "z", "lab")


@query(
    """SELECT pid, round((x - avg(x) OVER w) / (e + 0.01), 6) AS x, round((z - avg(z) OVER w) / (e + 0.01), 6) AS z, round(e, 6) AS diameter FROM (SELECT *,
    greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, max(z) OVER w - min(z) OVER w) AS e FROM seg WINDOW w AS (PARTITION BY super_index)) WINDOW w AS (PARTITION BY super_index)""",
    "seg",
)
def unit_sphere_norm(spark, d):
    return features.unit_sphere(segments(spark, d), "super_index").select("pid", "x", "z", "diameter")


@query("SELECT pid, round(cos(x / 100 * pi() / 2 * pow(10, ln(0.1))), 6) AS f0, round(sin(x / 100 * pi() / 2 * pow(10, ln(0.1))), 6) AS f1, round(cos(z / 100 * pi() / 2 * pow(10, ln(10))), 6) AS f6, 0.0::DOUBLE AS f8 FROM pts")
def fourier_encode(spark, d):
    f = features.fourier_encoded([F.col("x") / 100, F.col("z") / 100], 9)
    return points(spark, d).select("pid", f.alias("f")).select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in (0, 1, 6, 8)])


@query("SELECT pid, round(cos(radians(30)) * x - sin(radians(30)) * y, 6) AS x, round(sin(radians(30)) * x + cos(radians(30)) * y, 6) AS y, z FROM pts")
def rotate_fixed(spark, d):
    return features.rotated(points(spark, d).select("pid", "x", "y", "z"), features.rodrigues((0, 0, 1), 30.0))


@query("SELECT pid, -x AS x, y * 2 AS y, z FROM pts")
def scale_and_flip(spark, d):
    return features.flipped(features.scaled(points(spark, d), (1.0, 2.0, 1.0)), "x").select("pid", "x", "y", "z")


@query("SELECT pid, round(x - (SELECT avg(x) FROM pts WHERE lab = 1), 6) AS x, round(z - (SELECT avg(z) FROM pts WHERE lab = 1), 6) AS z FROM pts")
def centered(spark, d):
    p = points(spark, d)
    return features.centered(p, p.where("lab = 1")).select("pid", "x", "z")


@query("SELECT pid, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS room_x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS room_y FROM pts")
def room_position(spark, d):
    return features.room_position(points(spark, d)).select("pid", "room_x", "room_y")


@query(
    """WITH v AS (SELECT pid, x / n AS ux, (y - 200) / n AS uy, (z - 50) / n AS uz FROM (SELECT *, sqrt(x*x + (y-200)*(y-200) + (z-50)*(z-50)) AS n FROM pts WHERE x > 0))
    SELECT pid, round(ux, 6) AS b0x, round(-uy / sqrt(ux*ux+uy*uy), 6) AS b1x, round(ux / sqrt(ux*ux+uy*uy), 6) AS b1y, round(ux * ux / sqrt(ux*ux+uy*uy) + uy * uy / sqrt(ux*ux+uy*uy), 6) AS b2z FROM v"""
)
def base_vectors(spark, d):
    p = points(spark, d).where("x > 0")
    return p.select("pid", *features.base_vectors(F.col("x"), F.col("y") - 200, F.col("z") - 50)).select("pid", "b0x", "b1x", "b1y", "b2z")


@query("SELECT pid, z FROM pts WHERE z - (SELECT min(z) FROM pts) < 5")
def near_global_min(spark, d):
    return features.near_global_min(points(spark, d), 5.0).select("pid", "z")


@query("SELECT pid, z FROM pts QUALIFY row_number() OVER (PARTITION BY trunc(x / 20), trunc(y / 20) ORDER BY z, pid) = 1")
def local_z_min(spark, d):
    return features.local_z_min(points(spark, d), 20.0).select("pid", "z")


@query(
    """WITH ground AS (SELECT * FROM pts WHERE z < 10), near AS (SELECT a.pid, g.z AS gz, g.pid AS gp, sqrt((a.x-g.x)*(a.x-g.x) + (a.y-g.y)*(a.y-g.y)) AS d
    FROM pts a JOIN ground g ON g.y BETWEEN a.y - 10 AND a.y + 10 AND g.x BETWEEN a.x - 10 AND a.x + 10),
    best AS (SELECT * FROM near WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, gp) <= 3),
    lev AS (SELECT pid, sum(gz / (d + 1e-3)) / sum(1 / (d + 1e-3)) AS l FROM best GROUP BY 1)
    SELECT pid, round((z - l) / 3, 6) AS elevation FROM pts LEFT JOIN lev USING (pid)"""
)
def ground_elevation(spark, d):
    p = points(spark, d)
    return features.ground_elevation(p, p.where("z < 10")).select("pid", "elevation")


@query(
    """WITH s AS (SELECT covar_pop(x,x) xx, covar_pop(x,y) xy, covar_pop(y,y) yy, covar_pop(x,z) xz, covar_pop(y,z) yz, avg(x) mx, avg(y) my, avg(z) mz FROM pts),
    t AS (SELECT *, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS a, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS b FROM s) SELECT round(a, 6) AS a, round(b, 6) AS b, round(mz - a*mx - b*my, 6) AS c FROM t"""
)
def ground_plane(spark, d):
    return features.ground_plane(points(spark, d))


@query()
def ground_plane_ransac(spark, d):
    return features.robust_ground_plane(points(spark, d), 10.0)


# --- sampling, tiling, crops

_BOX = "(SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pts)"


@query(f"SELECT pid FROM pts, {_BOX} WHERE floor((x - lx) / (hx - lx) * 3) = 1 AND floor((y - ly) / (hy - ly) * 3) = 2")
def xy_tile(spark, d):
    return sampling.xy_tile(points(spark, d), 1, 2, 3).select("pid")


def _halved(rows: str, upper: bool) -> str:
    return f"""(SELECT pid, x, y FROM (SELECT *, quantile_disc(k, 0.5) OVER () AS m FROM (SELECT p.*, f * cos(h) * x + f * sin(h) * y AS k FROM {rows} p,
    (SELECT h, CASE WHEN cos(h) < 0 THEN -1 ELSE 1 END AS f FROM (SELECT 0.5 * atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) AS h FROM {rows})))) WHERE k {'>' if upper else '<='} m)"""


@query(f"WITH a AS {_halved('pts', True)}, b AS {_halved('a', False)} SELECT pid FROM b")
def pc_tile(spark, d):
    return sampling.recursive_tile(points(spark, d), 2, 2).select("pid")


@query("SELECT super_index, CAST(least(n, greatest(floor(32 * tanh(n / 32)), 5)) AS BIGINT) AS n FROM (SELECT super_index, count(*) AS n FROM seg GROUP BY 1)", "seg")
def sparse_sample_counts(spark, d):
    out = sampling.sparse_sample(segments(spark, d), "super_index", 32, 5)
    return out.groupBy("super_index").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT super_index, CAST(least(n, greatest(round_even(sqrt(n), 0), 1)) AS BIGINT) AS n FROM (SELECT super_index, count(*) AS n FROM seg GROUP BY 1)", "seg")
def sparse_sample_sqrt_counts(spark, d):
    out = sampling.sparse_sample(segments(spark, d), "super_index", 0, 1)
    return out.groupBy("super_index").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s, CAST(least(n, greatest(floor(3 * tanh(n / 3)), 2)) AS BIGINT) AS n FROM (SELECT s, count(*) AS n FROM adj GROUP BY 1)", "adj")
def edge_sample_counts(spark, d):
    return sampling.sample_edges(edges(spark, d), 2, 3).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT *, pow(n, 0.333) AS p, CAST(trunc(z / 10) AS INTEGER) AS y FROM (SELECT id, n, z FROM snode)), c AS (SELECT y, count(*) AS c FROM w GROUP BY 1)
    SELECT id, round(1 + p / (SELECT sum(p) FROM w) + 1 / sqrt(c) / (SELECT sum(1 / sqrt(c)) FROM c), 6) AS weight FROM w JOIN c USING (y)""",
    "snode",
)
def segment_sampling_weights(spark, d):
    rows = segment_nodes(spark, d).select("id", F.col("n").alias("node_size"), (F.col("z") / 10).cast("int").alias("y"))
    return sampling.segment_weights(rows, True, True).select("id", "weight")


@query("SELECT count(*) - CAST(floor(count(*) * 0.3) AS BIGINT) AS n FROM snode", "snode")
def sample_segments_count(spark, d):
    rows = segment_nodes(spark, d).select("id", F.col("n").alias("node_size"))
    return sampling.sample_segments(rows, 0.3, by_size=True).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH und AS (SELECT s, t FROM adj UNION SELECT t, s FROM adj), h0 AS (SELECT pid AS id FROM pts WHERE pid % 20 = 0),
    h1 AS (SELECT id FROM h0 UNION SELECT t FROM und WHERE s IN (SELECT id FROM h0)), h2 AS (SELECT id FROM h1 UNION SELECT t FROM und WHERE s IN (SELECT id FROM h1)) SELECT id FROM h2""",
    "adj",
)
def k_hop(spark, d):
    return sampling.k_hop(nodes(spark, d).where("id % 20 = 0"), edges(spark, d), 2)


@query(
    """SELECT i, j, round(d, 6) AS d FROM (SELECT a.pid AS i, b.pid AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM pts a, pts b WHERE a.pid % 20 = 0)
    WHERE d <= 20 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 6"""
)
def radius_crop(spark, d):
    p = points(spark, d)
    return sampling.radius_crop(p, p.where("pid % 20 = 0"), 20.0, 6)


@query("SELECT a.pid AS i, b.pid AS j, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 6) AS d FROM pts a, pts b WHERE a.pid % 20 = 0 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 225")
def cylinder_crop(spark, d):
    p = points(spark, d)
    return sampling.radius_crop(p, p.where("pid % 20 = 0"), 15.0, cylinder=True)


@query(
    """WITH und AS (SELECT s, t FROM adj UNION SELECT t, s FROM adj), h0 AS (SELECT pid AS id FROM pts WHERE pid % 20 = 0),
    h1 AS (SELECT id FROM h0 UNION SELECT t FROM und WHERE s IN (SELECT id FROM h0)), h2 AS (SELECT id FROM h1 UNION SELECT t FROM und WHERE s IN (SELECT id FROM h1)) SELECT id FROM h2""",
    "adj",
)
def k_hop_every_20th(spark, d):
    return sampling.k_hop(nodes(spark, d).where("id % 20 = 0"), edges(spark, d), 2)


@query(
    """SELECT i, j, round(d, 6) AS d FROM (SELECT a.pid AS i, b.pid AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM pts a, pts b WHERE a.pid % 20 = 0)
    WHERE d <= 20 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 6"""
)
def radius_crop_every_20th(spark, d):
    p = points(spark, d)
    return sampling.radius_crop(p, p.where("pid % 20 = 0"), 20.0, 6)


@query("SELECT a.pid AS i, b.pid AS j, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 6) AS d FROM pts a, pts b WHERE a.pid % 20 = 0 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 225")
def cylinder_crop_every_20th(spark, d):
    p = points(spark, d)
    return sampling.radius_crop(p, p.where("pid % 20 = 0"), 15.0, cylinder=True)


@query("SELECT least(count(*), 300) AS nodes FROM pts")
def restrict_size_count(spark, d):
    return sampling.restrict_size(nodes(spark, d), edges(spark, d), 300)[0].agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT lab, (SELECT min(n) FROM (SELECT count(*) AS n FROM pts GROUP BY lab)) AS n FROM (SELECT DISTINCT lab FROM pts)")
def balanced_sample_counts(spark, d):
    return sampling.balanced_sample(points(spark, d), "lab").groupBy("lab").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pid, row_number() OVER (PARTITION BY super_index ORDER BY y * 0.5 + x * 1.0 + z * 0.25, pid) - 1 AS place FROM seg", "seg")
def sort_along_direction(spark, d):
    return sampling.sort_along(segments(spark, d), "super_index", (1.0, 0.5, 0.25)).select("pid", "place")


@query("SELECT pid FROM pts WHERE (x-75)*(x-75) + (y-245)*(y-245) + (z-50)*(z-50) <= 10000")
def ball_crop(spark, d):
    return sampling.ball(points(spark, d), (75, 245, 50), 100.0).select("pid")


@query("SELECT super_index, quantile_disc(z, 0.5) AS median FROM seg GROUP BY 1", "seg")
def group_lower_median(spark, d):
    return ids.lower_median(segments(spark, d), "z", ["super_index"])


# --- pipelines, names, streams

SPEC = [{"transform": "xy_tile", "params": {"x": 0, "y": 1, "tiling": 2}}, [{"transform": "grid_sampling", "params": {"size": [10.0, 10.0, 10.0]}}]]


@query(
    f"""WITH t AS (SELECT pts.* FROM pts, {_BOX} WHERE floor((x - lx) / (hx - lx) * 2) = 0 AND floor((y - ly) / (hy - ly) * 2) = 1)
    SELECT CAST(round_even(x / 10, 0) AS BIGINT) AS cx, CAST(round_even(y / 10, 0) AS BIGINT) AS cy, CAST(round_even(z / 10, 0) AS BIGINT) AS cz, count(*) AS n,
    round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM t GROUP BY 1, 2, 3"""
)
def pipeline_run(spark, d):
    return pipelines.pipeline(SPEC)(points(spark, d))


@query("""SELECT md5('[{"params":{"tiling":2,"x":0,"y":1},"transform":"xy_tile"},{"params":{"size":[10.0,10.0,10.0]},"transform":"grid_sampling"}]') AS hash, count(*) AS points FROM pts""")
def pipeline_hash(spark, d):
    return points(spark, d).agg(F.count(F.lit(1)).alias("points")).select(F.lit(pipelines.spec_hash(SPEC)).alias("hash"), "points")


@query("SELECT 'c' || r_regionkey || '__TILE_' || i || '-' || j || '_OF_2-3' AS cloud_id FROM region, (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2, 3]) AS j)", "")
def tile_ids(spark, d):
    return clouds.tile_ids(table(spark, d, "region").select(F.concat(F.lit("c"), "r_regionkey").alias("cloud_id")), 2, 3)


@query("SELECT 'c' || r_regionkey || '__TILE_' || i || '-' || j || '_OF_2-3' AS cloud_id, 'c' || r_regionkey AS base, i - 1 AS i, j - 1 AS j FROM region, (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2, 3]) AS j)", "")
def parsed_tiles(spark, d):
    return clouds.parsed_tiles(tile_ids(spark, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2", "")
def events_tumbling(spark, d):
    from ..streaming import clouds as streams

    return streams.tumbling_counts(table(spark, d, "events"))


@query("SELECT pid, CAST(z AS DOUBLE) AS z, CAST(j IS NOT NULL AS BOOLEAN) AS filled FROM (SELECT pid, CASE WHEN pid % 3 = 0 THEN z END AS own FROM pts) a JOIN (SELECT pid, z, 1 AS j FROM pts) b USING (pid) WHERE pid % 3 = 0")
def unseen_kept(spark, d):
    p = points(spark, d)
    seen = p.where("pid % 3 = 0").select("pid", F.col("z").alias("v"))
    out = neighbors.interpolate_unseen(p, seen, ["v"], RADIUS)
    return out.where("pid % 3 = 0").select("pid", F.col("v").alias("z"), F.col("v").isNotNull().alias("filled"))


@query("SELECT s, t FROM sedge WHERE s % 2 = 0 AND t % 2 = 0", "sedge")
def selected_edges(spark, d):
    return hierarchy.select_edges(segment_edges(spark, d), segment_nodes(spark, d).where("id % 2 = 0")).select("s", "t")
