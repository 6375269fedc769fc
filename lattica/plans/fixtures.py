"""A point-cloud view of the driver's tables, in Spark and as DuckDB SQL, and how queries over it are registered.

A point is an event: x its user, y its value, z its property k; lab its type (label 4 stands for void with four classes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import graph, hierarchy, instances, neighbors

CLASSES = 4
#: Cells of this size, cut towards zero, stand for segments.
SEG = (20, 50)
RADIUS, K = 4.0, 5
LABELS = ("click", "view", "purchase", "error")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "pts"):
    """Registers a query under its function's name; `sql` is its twin, over the named common table expressions."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_ctes(sql, uses)
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    kinds = (DoubleType, FloatType)
    return df.select(*[F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])


def nearest(c, places: int = 6):
    """A double rounded by its scaled value, ties away from zero: `F.round` goes by the decimal form, which can lie on the other
    side of a tie."""
    return F.signum(c) * F.floor(F.abs(c) * 10.0**places + 0.5) / 10.0**places


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, number = table(spark, sf_dir, "events"), F.lit(CLASSES)
    for i, name in enumerate(LABELS):
        number = F.when(F.col("event_type") == name, i).otherwise(number)
    colour = lambda m: F.pmod(F.col("event_id") * m, F.lit(256))
    return e.select(
        F.col("event_id").alias("pid"),
        F.col("user_id").cast("double").alias("x"),
        F.col("value").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("z"),
        number.alias("lab"),
        F.pmod("user_id", F.lit(40)).alias("obj"),
        *[colour(m).alias(c) for c, m in (("r", 37), ("g", 59), ("b", 83))],
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with super_index."""
    at = (F.col("x") / SEG[0]).cast("long") * 1000 + (F.col("y") / SEG[1]).cast("long")
    return points(spark, sf_dir).withColumn("super_index", at)


def neighbours(spark: SparkSession, sf_dir: str, k: int = K, r: float = RADIUS) -> DataFrame:
    return neighbors.knn(points(spark, sf_dir), k, r)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, d) to the nearest neighbours."""
    return neighbours(spark, sf_dir).select(F.col("i").alias("s"), F.col("j").alias("t"), "d")


def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trimmed(edges(spark, sf_dir), {"d": "min"})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumnRenamed("pid", "id")


def segment_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, n, log_size) of the segments."""
    rows = segments(spark, sf_dir).groupBy(F.col("super_index").alias("id")).agg(*[F.avg(d).alias(d) for d in "xyz"], F.count(F.lit(1)).alias("n"))
    return rows.withColumn("log_size", F.log(F.col("n") + 1))


def super_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, s, t, d): neighbouring points of different segments."""
    return graph.superedges(trim(spark, sf_dir), segments(spark, sf_dir).withColumnRenamed("pid", "id"))


def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trimmed(super_edges(spark, sf_dir), {"d": "min"})


def overlap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, obj, cnt, y): segments against objects of one label each."""
    return instances.overlaps(segments(spark, sf_dir).withColumn("obj", F.col("obj") * 5 + F.col("lab")), "super_index", "obj", "lab")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, obj, cnt, y, pred_y, score): predictions that hold most of an object and some of the one before."""
    obj = F.col("obj") * 5 + F.col("lab")
    rows = points(spark, sf_dir).withColumn("cluster", obj + F.when(F.col("pid") % 7 == 0, 1).otherwise(0)).withColumn("obj", obj)
    out = instances.overlaps(rows, "cluster", "obj", "lab")
    best = instances.major(out).select("cluster", F.when(F.col("y") >= CLASSES, 0).otherwise(F.col("y")).alias("pred_y"))
    return out.join(best, "cluster").withColumn("score", F.pmod(F.col("cluster") * 37, F.lit(101)) / 101)


def cloud(spark: SparkSession, sf_dir: str) -> hierarchy.Hierarchy:
    return hierarchy.grid_hierarchy(points(spark, sf_dir), [20.0, 60.0])


#: name -> (names that it needs, SQL)
CTES = {
    "pts": (
        "",
        f"""SELECT event_id AS pid, CAST(user_id AS DOUBLE) AS x, value AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z,
        CAST(coalesce(list_position({list(LABELS)}, event_type) - 1, {CLASSES}) AS INTEGER) AS lab, user_id % 40 AS obj,
        event_id * 37 % 256 AS r, event_id * 59 % 256 AS g, event_id * 83 % 256 AS b FROM events""",
    ),
    "vox": ("pts", "SELECT *, " + ", ".join(f"CAST(round_even({d} / 10, 0) AS BIGINT) AS c{d}" for d in "xyz") + " FROM pts"),
    "seg": ("pts", f"SELECT *, CAST(trunc(x / {SEG[0]}) AS BIGINT) * 1000 + CAST(trunc(y / {SEG[1]}) AS BIGINT) AS super_index FROM pts"),
    "near": (
        "pts",
        f"""SELECT * FROM (SELECT a.pid AS i, b.pid AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
        FROM pts a JOIN pts b ON b.y BETWEEN a.y - {RADIUS} AND a.y + {RADIUS} AND b.x BETWEEN a.x - {RADIUS} AND a.x + {RADIUS}) WHERE d <= {RADIUS}""",
    ),
    "nbr": ("near", f"SELECT i, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank, j, d FROM near WHERE i <> j QUALIFY rank <= {K}"),
    "adj": ("nbr", "SELECT i AS s, j AS t, d FROM nbr"),
    "trim": ("adj", "SELECT least(s, t) AS s, greatest(s, t) AS t, min(d) AS d FROM adj GROUP BY 1, 2"),
    "sup": (
        "trim seg",
        """SELECT CASE WHEN a.super_index > b.super_index THEN e.t ELSE e.s END AS i, CASE WHEN a.super_index > b.super_index THEN e.s ELSE e.t END AS j,
        least(a.super_index, b.super_index) AS s, greatest(a.super_index, b.super_index) AS t, d
        FROM trim e JOIN seg a ON a.pid = e.s JOIN seg b ON b.pid = e.t WHERE a.super_index <> b.super_index""",
    ),
    "sedge": ("sup", "SELECT s, t, min(d) AS d FROM sup GROUP BY 1, 2"),
    "snode": ("seg", "SELECT super_index AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, ln(count(*) + 1) AS log_size FROM seg GROUP BY 1"),
    "ov": ("seg", "SELECT super_index AS cluster, obj * 5 + lab AS obj, count(*) AS cnt, min(lab) AS y FROM seg GROUP BY 1, 2"),
    "maj": ("ov", "SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, obj) = 1"),
    "ovp0": ("pts", "SELECT obj * 5 + lab + CASE WHEN pid % 7 = 0 THEN 1 ELSE 0 END AS cluster, obj * 5 + lab AS obj, count(*) AS cnt, min(lab) AS y FROM pts GROUP BY 1, 2"),
    "ovp": (
        "ovp0",
        f"""SELECT *, cluster * 37 % 101 / 101.0::DOUBLE AS score FROM ovp0 JOIN (SELECT cluster, CASE WHEN y >= {CLASSES} THEN 0 ELSE y END AS pred_y FROM ovp0
        QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, obj) = 1) USING (cluster)""",
    ),
    "clean": (
        "ovp",
        f"""SELECT cluster, obj, cnt, y, pred_y, score, cropped FROM (SELECT *, sum(CASE WHEN gone THEN cnt ELSE 0 END) OVER (PARTITION BY obj) AS cropped FROM (
        SELECT *, 2 * sum(CASE WHEN y >= {CLASSES} THEN cnt ELSE 0 END) OVER (PARTITION BY cluster) > sum(cnt) OVER (PARTITION BY cluster) AS gone FROM ovp))
        WHERE NOT gone AND y < {CLASSES}""",
    ),
    "iou": (
        "clean",
        """SELECT *, cnt / (a + b - cnt) AS iou FROM (SELECT *, sum(cnt) OVER (PARTITION BY cluster) AS a,
        sum(cnt) OVER (PARTITION BY obj) + cropped AS b FROM clean)""",
    ),
    "h0": ("pts", "SELECT *, dense_rank() OVER (ORDER BY trunc(x / 20), trunc(y / 20)) - 1 AS super_index FROM pts"),
    "h1n": ("h0", "SELECT super_index AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_children FROM h0 GROUP BY 1"),
    "h1": ("h1n", "SELECT *, dense_rank() OVER (ORDER BY trunc(x / 60), trunc(y / 60)) - 1 AS super_index FROM h1n"),
    "h2": ("h1", "SELECT super_index AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_children FROM h1 GROUP BY 1"),
}


def with_ctes(sql: str, uses: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][0].split():
            add(x)
        if name not in order:
            order.append(name)

    for name in uses.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {sql[len('WITH RECURSIVE'):]}" if parts else sql
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {sql[5:]}" if parts else sql
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
