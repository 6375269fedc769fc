"""Neighbour search, graphs and their edge features, partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, neighbors, partition, sampling
from .fixtures import RADIUS, edges, neighbours, nodes, points, query, segment_edges, segment_nodes, segments, super_edges, table, trim

# --- neighbours


@query("SELECT i, CAST(rank AS INTEGER) AS rank, j, round(d, 6) AS d FROM nbr", "nbr")
def knn_grid(spark, d):
    return neighbours(spark, d)


@query(
    """SELECT i, CAST(rank AS INTEGER) AS rank, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (
    SELECT a.pid AS i, b.pid AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM pts a JOIN pts b ON b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3
    WHERE a.lab = 0 AND b.lab = 1) WHERE d <= 3) WHERE rank <= 4"""
)
def knn_between(spark, d):
    p = points(spark, d)
    return neighbors.knn_between(p.where("lab = 0"), p.where("lab = 1"), 4, 3.0, ("x", "y"))


@query(
    """SELECT i, CAST(rank AS INTEGER) AS rank, j, round(d, 5) AS d FROM (SELECT a.vec_id AS i, b.vec_id AS j,
    sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda e: (e[1]::DOUBLE - e[2]::DOUBLE) * (e[1]::DOUBLE - e[2]::DOUBLE)))) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5""",
    "",
)
def knn_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    out = neighbors.knn_vectors(e.where("vec_id % 20 = 0"), e, 5)
    return out.select("i", "rank", "j", F.round("d", 5).alias("d"))


@query("SELECT i, CAST(k AS INTEGER) AS rank, j, round(d, 6) AS d FROM (SELECT i, max(rank) AS n FROM nbr GROUP BY 1) JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) ON true JOIN nbr USING (i) WHERE rank = (k - 1) % n + 1", "nbr")
def knn_oversampled(spark, d):
    return neighbors.oversampled(neighbours(spark, d), 5)


@query("SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY rank) AS js FROM nbr GROUP BY 1", "nbr")
def knn_arrays(spark, d):
    out = neighbors.dense_neighbors(neighbours(spark, d))
    return out.select("i", F.array_join(F.transform("js", lambda v: v.cast("string")), ",").alias("js"))


@query("SELECT i AS pid FROM near WHERE i <> j GROUP BY 1 HAVING count(*) >= 2", "near")
def radius_inliers(spark, d):
    return neighbors.inliers(points(spark, d), 2, RADIUS).select("pid")


@query("SELECT pid FROM pts WHERE pid NOT IN (SELECT i FROM near WHERE i <> j GROUP BY 1 HAVING count(*) >= 2)", "near")
def radius_outliers(spark, d):
    return neighbors.outliers(points(spark, d), 2, RADIUS).select("pid")


@query(
    """WITH a AS (SELECT i FROM near WHERE i <> j GROUP BY 1 HAVING count(*) >= 2)
    SELECT i AS pid FROM near WHERE i <> j AND i IN (SELECT i FROM a) AND j IN (SELECT i FROM a) GROUP BY 1 HAVING count(*) >= 2""",
    "near",
)
def radius_inliers_two_rounds(spark, d):
    return neighbors.inliers(points(spark, d), 2, RADIUS, recursive=True, rounds=2).select("pid")


@query()
def radius_inliers_recursive(spark, d):
    return neighbors.inliers(points(spark, d), 2, RADIUS, recursive=True).select("pid")


@query("SELECT a.super_index AS s, b.super_index AS t, round(min(d), 6) AS d FROM near JOIN seg a ON a.pid = i JOIN seg b ON b.pid = j WHERE a.super_index < b.super_index GROUP BY 1, 2", "near seg")
def cluster_radius_graph(spark, d):
    return neighbors.cluster_radius_graph(segments(spark, d), "super_index", RADIUS)


@query(
    """WITH g AS (SELECT a.super_index AS s, b.super_index AS t, min(d) AS d FROM near JOIN seg a ON a.pid = i JOIN seg b ON b.pid = j WHERE a.super_index <> b.super_index GROUP BY 1, 2),
    k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, t) <= 2) SELECT least(s, t) AS s, greatest(s, t) AS t, round(min(d), 6) AS d FROM k GROUP BY 1, 2""",
    "near seg",
)
def cluster_radius_graph_k(spark, d):
    return neighbors.cluster_radius_graph(segments(spark, d), "super_index", RADIUS, k_max=2)


def _closest(source: str, anchor: str, end: str) -> str:
    d2 = " + ".join(f"(a.{c}-p.{c})*(a.{c}-p.{c})" for c in "xyz")
    return f"{anchor} AS (SELECT a.s, a.t, p.pid, p.x, p.y, p.z, sqrt({d2}) AS d FROM {source} a JOIN seg p ON p.super_index = a.{end} QUALIFY row_number() OVER (PARTITION BY a.s, a.t ORDER BY {d2}, p.pid) = 1)"


@query(
    "WITH a0 AS (SELECT sedge.s, sedge.t, x, y, z FROM sedge JOIN snode ON id = s), "
    + ", ".join(_closest(f"a{k}", f"a{k + 1}", "t" if k % 2 == 0 else "s") for k in range(6))
    + " SELECT a6.s, a6.t, a6.pid AS i, a5.pid AS j, round(a6.d, 6) AS d FROM a6 JOIN a5 ON a5.s = a6.s AND a5.t = a6.t",
    "sedge snode",
)
def nearest_pair(spark, d):
    return neighbors.nearest_pairs(segments(spark, d), segment_edges(spark, d), "super_index")


@query("SELECT s, t, side, pid FROM (SELECT s, t, 's' AS side, s AS own FROM sedge UNION ALL SELECT s, t, 't', t FROM sedge) JOIN seg ON super_index = own", "sedge")
def edge_wise_points(spark, d):
    return neighbors.edge_wise_points(segments(spark, d), segment_edges(spark, d), "super_index")


@query(
    """WITH near3 AS (SELECT i, j, d FROM near WHERE i % 3 <> 0 AND j % 3 = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1)
    SELECT p.pid, CASE WHEN p.pid % 3 = 0 THEN p.z ELSE q.z END AS v FROM pts p LEFT JOIN near3 ON i = p.pid LEFT JOIN pts q ON q.pid = near3.j""",
    "near",
)
def unseen_from_nearest(spark, d):
    p = points(spark, d)
    seen = p.where("pid % 3 = 0").select("pid", F.col("z").alias("v"))
    return neighbors.interpolate_unseen(p, seen, ["v"], RADIUS).select("pid", "v")


# --- graphs


@query("SELECT s, t, round(1 / (1 + d / (SELECT avg(d) FROM adj)), 6) AS w FROM adj", "adj")
def adjacency(spark, d):
    return graph.adjacency(neighbours(spark, d), 5, 1.0)


@query("SELECT least(s, t) AS s, greatest(s, t) AS t, round(avg(d), 6) AS d FROM adj GROUP BY 1, 2", "adj")
def trim_mean(spark, d):
    return graph.trimmed(edges(spark, d), {"d": "mean"})


@query("SELECT s, t, round(d, 6) AS d FROM trim", "trim")
def trim_min(spark, d):
    return trim(spark, d)


@query("SELECT i, j, s, t, round(d, 6) AS d FROM sup", "sup")
def superedges(spark, d):
    return super_edges(spark, d)


@query("SELECT i, j, s, t, dense_rank() OVER (ORDER BY s, t) - 1 AS se_id FROM sup", "sup")
def superedge_ids(spark, d):
    return graph.with_superedge_ids(super_edges(spark, d)).select("i", "j", "s", "t", "se_id")


@query("SELECT pid AS id FROM pts WHERE pid NOT IN (SELECT s FROM adj UNION ALL SELECT t FROM adj)", "adj")
def isolated(spark, d):
    return graph.isolated(nodes(spark, d), edges(spark, d)).select("id")


@query(
    """WITH e AS (SELECT s, t, d * 2 + s % 3 AS w, d FROM adj WHERE d <= 2), alone AS (SELECT * FROM pts WHERE pid NOT IN (SELECT s FROM e UNION ALL SELECT t FROM e)),
    f AS (SELECT regr_slope(w, d) AS a, regr_intercept(w, d) AS b FROM e),
    n AS (SELECT i, j, d FROM near WHERE i <> j AND i IN (SELECT pid FROM alone) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 1)
    SELECT s, t, round(w, 6) AS w FROM e UNION ALL SELECT i, j, round(a * d + b, 6) FROM n, f""",
    "near adj",
)
def connect_isolated(spark, d):
    e = edges(spark, d).where("d <= 2").select("s", "t", (F.col("d") * 2 + F.col("s") % 3).alias("w"))
    return graph.connect_isolated(nodes(spark, d), e, RADIUS)


@query("SELECT s, t, round(d, 6) AS d FROM adj", "adj")
def edge_lengths(spark, d):
    return graph.edge_lengths(nodes(spark, d), edges(spark, d).select("s", "t"))


@query(
    """WITH o AS (SELECT s, t, b.x - a.x AS ox, b.y - a.y AS oy, b.z - a.z AS oz FROM sup JOIN pts a ON a.pid = i JOIN pts b ON b.pid = j)
    SELECT s, t, round(avg(ox), 6) AS mean_off_x, round(avg(oy), 6) AS mean_off_y, round(avg(oz), 6) AS mean_off_z, round(least(2, sqrt(var_pop(ox) + var_pop(oy) + var_pop(oz))), 6) AS std_off,
    round(sqrt(avg(sqrt(ox*ox + oy*oy + oz*oz))), 6) AS mean_dist, count(*) AS n_pairs FROM o GROUP BY 1, 2""",
    "sup",
)
def edge_features_minimal(spark, d):
    return graph.minimal_edge_features(super_edges(spark, d), points(spark, d))


_ENDS = """sqrt(l) AS centroid_dist, ox / CASE WHEN l > 0 THEN l ELSE 1 END AS dir_x, oy / CASE WHEN l > 0 THEN l ELSE 1 END AS dir_y, oz / CASE WHEN l > 0 THEN l ELSE 1 END AS dir_z"""
_OFF = "b.x - a.x AS ox, b.y - a.y AS oy, b.z - a.z AS oz, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)) AS l, b.log_size - a.log_size AS dl"
_ROUND = "round(dir_x, 6) AS dir_x, round(dir_y, 6) AS dir_y, round(dir_z, 6) AS dir_z, round(centroid_dist, 6) AS centroid_dist, round(dl, 6) AS d_log_size"


@query(
    f"""WITH e AS (SELECT s, t FROM sedge UNION ALL SELECT t, s FROM sedge), o AS (SELECT s, t, {_OFF} FROM e JOIN snode a ON a.id = s JOIN snode b ON b.id = t),
    f AS (SELECT s, t, dl, {_ENDS} FROM o) SELECT s, t, {_ROUND} FROM f""",
    "sedge snode",
)
def edge_features_h(spark, d):
    return graph.horizontal_edge_features(segment_edges(spark, d), segment_nodes(spark, d), ["log_size"])


@query(
    f"""WITH c AS (SELECT *, ln(lab + 1) AS log_size FROM seg), o AS (SELECT a.pid AS s, b.id AS t, {_OFF} FROM c a JOIN snode b ON b.id = a.super_index),
    f AS (SELECT s, t, dl, {_ENDS} FROM o) SELECT s, t, {_ROUND} FROM f""",
    "snode",
)
def edge_features_v(spark, d):
    children = segments(spark, d).withColumnRenamed("pid", "id").withColumn("log_size", F.log(F.col("lab") + 1))
    return graph.vertical_edge_features(children, segment_nodes(spark, d), ["log_size"])


@query("SELECT s, t, round(d, 6) AS d FROM sedge UNION ALL SELECT id, id, 0 FROM snode", "sedge snode")
def self_loops(spark, d):
    return graph.add_self_loops(segment_edges(spark, d), segment_nodes(spark, d))


@query("SELECT s, t, round(d, 6) AS d FROM sedge UNION ALL SELECT t, s, -round(d, 6) FROM sedge", "sedge")
def both_directions(spark, d):
    return graph.both_directions(segment_edges(spark, d), ["d"])


@query()
def border_pairs(spark, d):
    return graph.border_pairs(segments(spark, d), segment_edges(spark, d), "super_index")


# --- partitions


@query(
    """WITH RECURSIVE e AS (SELECT s, t FROM trim WHERE d <= 2 UNION ALL SELECT t, s FROM trim WHERE d <= 2),
    reach AS (SELECT pid AS id, pid AS b FROM pts UNION SELECT reach.id, e.t FROM reach JOIN e ON e.s = reach.b) SELECT id, max(b) AS label FROM reach GROUP BY 1""",
    "trim",
)
def wcc(spark, d):
    return partition.components(nodes(spark, d), trim(spark, d).where("d <= 2"))


@query(
    """WITH e AS (SELECT s, t FROM trim UNION ALL SELECT t, s FROM trim), a AS (SELECT pid AS id, pid AS l FROM pts),
    b AS (SELECT a.id, greatest(a.l, coalesce(max(n.l), a.l)) AS l FROM a LEFT JOIN e ON e.s = a.id LEFT JOIN a n ON n.id = e.t GROUP BY a.id, a.l)
    SELECT b.id, greatest(b.l, coalesce(max(n.l), b.l)) AS label FROM b LEFT JOIN e ON e.s = b.id LEFT JOIN b n ON n.id = e.t GROUP BY b.id, b.l""",
    "trim",
)
def wcc_two_hops(spark, d):
    return partition.components(nodes(spark, d), trim(spark, d), rounds=2)


@query("SELECT s, t, round(d, 6) AS d, round(exp(-d / 2.0), 6) AS w FROM trim", "trim")
def edge_weights_exp(spark, d):
    return partition.edge_weights(trim(spark, d), "exp", 2.0)


@query("SELECT s, t, round(d, 6) AS d, round(1 / (1 + d / (SELECT avg(d) FROM trim)), 6) AS w FROM trim", "trim")
def edge_weights_inverse(spark, d):
    return partition.edge_weights(trim(spark, d), "inverse")


@query("SELECT s, t, round(1 / (1 + exp(-(d - 2))) / (1 - 1 / (1 + exp(-(d - 2))) + 1e-3), 6) AS w FROM trim", "trim")
def instance_weights(spark, d):
    return partition.instance_weights(trim(spark, d).select("s", "t", (F.col("d") - 2).alias("logit"))).select("s", "t", "w")


def _energy_nodes(spark, d):
    return points(spark, d).select(F.col("pid").alias("id"), F.lit(1).alias("n"), F.array((F.col("y") / 100).alias("v"), F.col("z") / 100).alias("x"), (F.col("x") / 20).cast("long").alias("tile"))


@query()
def greedy_merge(spark, d):
    e = trim(spark, d).withColumn("w", F.lit(1.0))
    return partition.greedy_merge(_energy_nodes(spark, d), e, 0.05, 2)


@query()
def l0_partition(spark, d):
    e = trim(spark, d).withColumn("w", F.lit(1.0))
    return partition.cut_pursuit(_energy_nodes(spark, d), e, 0.05)


@query(
    """WITH v AS (SELECT pid, lab AS label, y / 100 AS a, z / 100 AS b FROM pts), m AS (SELECT label, avg(a) AS ma, avg(b) AS mb FROM v GROUP BY 1),
    f AS (SELECT sum((a - ma) * (a - ma) + (b - mb) * (b - mb)) AS fidelity FROM v JOIN m USING (label)),
    c AS (SELECT count(*)::DOUBLE AS contour FROM trim JOIN v p ON p.pid = s JOIN v q ON q.pid = t WHERE p.label <> q.label)
    SELECT round(fidelity, 6) AS fidelity, contour, round(fidelity + 0.05 * contour, 6) AS energy FROM f, c""",
    "trim",
)
def partition_energy(spark, d):
    labels = points(spark, d).select(F.col("pid").alias("id"), F.col("lab").cast("long").alias("label"))
    e = trim(spark, d).withColumn("w", F.lit(1.0))
    return partition.partition_energy(_energy_nodes(spark, d).select("id", "n", "x"), e, labels, 0.05)


@query("SELECT pid AS id, CASE WHEN lab IN (0, 2) THEN min(obj) OVER (PARTITION BY lab) ELSE obj END AS label, lab AS y FROM pts")
def stuff_merge(spark, d):
    rows = points(spark, d).select(F.col("pid").alias("id"), F.col("obj").alias("label"), F.col("lab").alias("y"))
    return partition.stuff_merged(rows, [0, 2])


@query("SELECT super_index AS setting_id, round(avg(z), 6) AS pq FROM seg GROUP BY 1 ORDER BY avg(z) DESC, 1 LIMIT 1", "seg")
def setting_sweep(spark, d):
    rows = segments(spark, d).groupBy(F.col("super_index").alias("setting_id")).agg(F.avg("z").alias("pq"))
    return partition.sweep(rows, "pq")


@query("SELECT s, t, round(d, 6) AS d FROM trim WHERE s IN (SELECT pid FROM pts WHERE lab = 0) AND t IN (SELECT pid FROM pts WHERE lab = 0)", "trim")
def induced_subgraph(spark, d):
    from ..operators.hierarchy import select_edges

    return select_edges(trim(spark, d), nodes(spark, d).where("lab = 0")).select("s", "t", "d")


@query("SELECT count(*) AS n FROM (SELECT s, t FROM trim LIMIT 100)", "trim")
def restrict_edges_count(spark, d):
    return sampling.restrict_size(nodes(spark, d), trim(spark, d), 0, 100)[1].agg(F.count(F.lit(1)).alias("n"))
