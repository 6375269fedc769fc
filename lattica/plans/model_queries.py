"""Inference operators and losses over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nn
from .fixtures import edges, nearest, nodes, points, query, segment_nodes, segments

N_LOGITS = 5
_LOGITS = ", ".join(f"(pid * {31 + 4 * i} % 97) / 97.0::DOUBLE AS l{i}" for i in range(N_LOGITS))
_SUM = " + ".join(f"exp(l{i})" for i in range(N_LOGITS))
_PICK = "CASE lab " + " ".join(f"WHEN {i} THEN exp(l{i}) / ({_SUM})" for i in range(N_LOGITS)) + " END"


def _logits(df):
    return df.withColumn("logits", F.array(*[F.pmod(F.col("pid") * (31 + 4 * i), F.lit(97)) / 97 for i in range(N_LOGITS)]))


def _pooled(how):
    def run(spark, d):
        return nn.pool(segments(spark, d), ["z"], how)

    run.__name__ = f"pool_{how}"
    sql = {"sum": "sum(z)", "mean": "avg(z)", "max": "max(z)", "min": "min(z)", "std": "coalesce(stddev_samp(z), 0)"}[how]
    return query(f"SELECT super_index, round({sql}, 6) AS z FROM seg GROUP BY 1", "seg")(run)


pool_sum, pool_mean, pool_max, pool_min, pool_std = (_pooled(how) for how in ("sum", "mean", "max", "min", "std"))


@query("SELECT pid, super_index, round(snode.z, 6) AS parent_z FROM seg JOIN snode ON id = super_index", "snode")
def unpool(spark, d):
    return nn.unpool(segments(spark, d).select("pid", "super_index"), segment_nodes(spark, d), ["z"]).select("pid", "super_index", "parent_z")


@query("SELECT pid, x + z AS r0, y + x AS r1 FROM pts")
def fuse_residual(spark, d):
    f = nn.fuse("residual", F.array("x", "y"), F.array("z", "x"))
    return points(spark, d).select("pid", f.alias("f")).select("pid", *[F.get("f", F.lit(i)).alias(f"r{i}") for i in range(2)])


@query("SELECT pid, x AS c0, z AS c1, y AS c2, x AS f0, z AS f1, y AS s0, CASE WHEN lab = 1 THEN x ELSE y END AS m0 FROM pts")
def fuse_modes(spark, d):
    a, b = F.array("x", "z"), F.array("y")
    only = F.when(F.col("lab") != 1, b)  # a missing side gives the other
    made = {"c": nn.fuse("cat", a, b), "f": nn.fuse("first", a, b), "s": nn.fuse("second", a, b), "m": nn.fuse("second", a, only)}
    rows = points(spark, d).select("pid", *[c.alias(f"_{n}") for n, c in made.items()])
    return rows.select("pid", *[F.get(f"_{n}", F.lit(i)).alias(f"{n}{i}") for n, width in (("c", 3), ("f", 2), ("s", 1), ("m", 1)) for i in range(width)])


@query("SELECT s, t, round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY s), 6) AS a FROM adj", "adj")
def edge_softmax(spark, d):
    return nn.edge_softmax(edges(spark, d).select("s", "t", (-F.col("d")).alias("score"))).select("s", "t", "a")


_QK = "e AS (SELECT s, exp((a.x / 100 * b.y / 500 + a.y / 500 * b.z / 100) / sqrt(2)) AS w, b.x AS v0, b.z AS v1 FROM adj JOIN pts a ON a.pid = s JOIN pts b ON b.pid = t)"


@query(f"WITH {_QK} SELECT s AS id, round(sum(w * v0) / sum(w), 6) AS o0, round(sum(w * v1) / sum(w), 6) AS o1 FROM e GROUP BY 1", "adj")
def attention_sparse(spark, d):
    n = nodes(spark, d).select("id", F.array(F.col("x") / 100, F.col("y") / 500).alias("q"), F.array(F.col("y") / 500, F.col("z") / 100).alias("k"), F.array("x", "z").alias("v"))
    out = nn.attention(edges(spark, d), n, 2)
    return out.select("id", *[F.get("out", F.lit(i)).alias(f"o{i}") for i in range(2)])


@query("WITH e AS (SELECT super_index, exp((0.5 * y / 500 + 0.25 * z / 100) / sqrt(2)) AS w, x, z FROM seg) SELECT super_index AS id, round(sum(w * x) / sum(w), 6) AS o0, round(sum(w * z) / sum(w), 6) AS o1 FROM e GROUP BY 1", "seg")
def attentive_pool(spark, d):
    rows = segments(spark, d).select(F.col("pid").alias("id"), "super_index", F.array(F.col("y") / 500, F.col("z") / 100).alias("k"), F.array("x", "z").alias("v"))
    out = nn.attentive_pool(rows, None, 2, [0.5, 0.25])
    return out.select("id", *[F.get("out", F.lit(i)).alias(f"o{i}") for i in range(2)])


@query(
    """WITH h AS (SELECT pid, (x / 100) * 0.5::DOUBLE + (y / 500) * -1.0::DOUBLE + 0.1::DOUBLE AS a, (x / 100) * 0.25::DOUBLE + (y / 500) * 0.5::DOUBLE + -0.2::DOUBLE AS b FROM pts), r AS (SELECT pid, CASE WHEN a < 0 THEN a * 0.01::DOUBLE ELSE a END AS a, CASE WHEN b < 0 THEN b * 0.01::DOUBLE ELSE b END AS b FROM h)
    SELECT pid, round(a * 2.0::DOUBLE + b * -1.0::DOUBLE + 0.3::DOUBLE, 6) AS out FROM r"""
)
def mlp(spark, d):
    rows = points(spark, d).select("pid", F.array(F.col("x") / 100, F.col("y") / 500).alias("f"))
    layers = [([[0.5, -1.0], [0.25, 0.5]], [0.1, -0.2]), ([[2.0, -1.0]], [0.3])]
    # many results lie on ties of the sixth place
    return nn.mlp(rows, "f", layers, last_activation=False).select("pid", nearest(F.get("f", F.lit(0))).alias("out"))


@query(
    """WITH g AS (SELECT lab, avg(v) FILTER (WHERE g = 0) AS m0, var_pop(v) FILTER (WHERE g = 0) AS v0, avg(v) FILTER (WHERE g = 1) AS m1, var_pop(v) FILTER (WHERE g = 1) AS v1 FROM (
    SELECT lab, 0 AS g, x AS v FROM pts UNION ALL SELECT lab, 0, y FROM pts UNION ALL SELECT lab, 1, z FROM pts UNION ALL SELECT lab, 1, r FROM pts) GROUP BY 1)
    SELECT pid, round((x - m0) / sqrt(v0 + 1e-5), 6) AS f0, round((y - m0) / sqrt(v0 + 1e-5), 6) AS f1, round((z - m1) / sqrt(v1 + 1e-5), 6) AS f2, round((r - m1) / sqrt(v1 + 1e-5), 6) AS f3 FROM pts JOIN g USING (lab)"""
)
def group_norm(spark, d):
    rows = points(spark, d).select("pid", "lab", F.array("x", "y", "z", F.col("r").cast("double")).alias("f"))
    out = nn.group_norm(rows, "f", 2, "lab")
    return out.select("pid", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(4)])


@query("SELECT pid, round((x - avg(x) OVER ()) / sqrt(var_pop(x) OVER () + 1e-5), 6) AS x, round((z - avg(z) OVER ()) / sqrt(var_pop(z) OVER () + 1e-5), 6) AS z FROM pts")
def batch_norm(spark, d):
    return nn.batch_norm(points(spark, d).select("pid", "x", "z"), ["x", "z"])


@query(
    """WITH c AS (SELECT cx, cy, cz, count(*)::DOUBLE AS v FROM vox GROUP BY ALL), k AS (SELECT * FROM (VALUES (0, 0, 0, 1.0::DOUBLE), (1, 0, 0, 0.5), (0, -1, 0, 0.25)) t(ox, oy, oz, w))
    SELECT a.cx, a.cy, a.cz, round(sum(w * b.v), 6) AS out FROM c a, k JOIN c b ON b.cx = a.cx + ox AND b.cy = a.cy + oy AND b.cz = a.cz + oz GROUP BY ALL""",
    "vox",
)
def sparse_conv(spark, d):
    from ..operators.voxels import with_cells

    cells = with_cells(points(spark, d), (10.0, 10.0, 10.0)).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return nn.sparse_conv(cells, {(0, 0, 0): 1.0, (1, 0, 0): 0.5, (0, -1, 0): 0.25})


@query("SELECT pid, round(sum(z * k), 6) AS z FROM pts, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1")
def tta_sum(spark, d):
    p = points(spark, d).select("pid", "z")
    runs = p.select("pid", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: k * F.col("z"))).alias("z"))
    return nn.accumulate_runs(runs, "pid", ["z"])


@query(
    f"""WITH l AS (SELECT pid, obj, 1 + pid % 3 AS sz, {_LOGITS} FROM pts), m AS (SELECT obj, {', '.join(f'sum(l{i} * sz) / sum(sz) AS l{i}' for i in range(N_LOGITS))} FROM l GROUP BY 1),
    s AS (SELECT obj, [{', '.join(f'exp(l{i}) / ({_SUM})' for i in range(N_LOGITS))}] AS p FROM m)
    SELECT obj, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label, round(list_max(p), 6) AS score FROM s"""
)
def instance_prediction(spark, d):
    rows = _logits(points(spark, d)).withColumn("sz", 1 + F.pmod("pid", F.lit(3)))
    return nn.instance_prediction(rows, "obj", "logits", "sz")


# --- losses


@query(f"WITH l AS (SELECT pid, lab, {_LOGITS} FROM pts), p AS (SELECT {_PICK} AS p, list_extract([1.0, 2.0, 1.5, 1.0, 0.5], lab + 1)::DOUBLE AS w FROM l) SELECT round(sum(w * pow(1 - p, 2) * -ln(p)) / sum(w), 6) AS loss FROM p")
def focal_loss(spark, d):
    return nn.focal_loss(_logits(points(spark, d)), "logits", "lab", 2.0, [1.0, 2.0, 1.5, 1.0, 0.5])


@query(
    """WITH p AS (SELECT 1 / (1 + exp(-(z / 50 - 1))) * (1 - 2e-6) + 1e-6 AS p, CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END AS y FROM pts)
    SELECT round(avg(-(0.5 * y * pow(1 - p, 2) * ln(p) + 0.5 * (1 - y) * pow(p, 2) * ln(1 - p))), 6) AS loss FROM p"""
)
def binary_focal_loss(spark, d):
    rows = points(spark, d).select((F.col("z") / 50 - 1).alias("logit"), (F.col("lab") == 1).cast("double").alias("target"))
    return nn.binary_focal_loss(rows, "logit", "target", 2.0)


@query(
    """WITH p AS (SELECT z / 50 - 1 AS x, CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END AS y, 1 + lab AS w FROM pts)
    SELECT round(sum(w * ((1 - y) * x + (1 + y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0)))) / sum(w), 6) AS loss FROM p"""
)
def bce_loss(spark, d):
    rows = points(spark, d).select((F.col("z") / 50 - 1).alias("logit"), (F.col("lab") == 1).cast("double").alias("target"), (F.col("lab") + 1).alias("w"))
    return nn.bce_loss(rows, "logit", "target", "w", 2.0)


@query(
    """WITH r AS (SELECT pid, c AS class, abs(CASE WHEN lab = c THEN 1 ELSE 0 END - (pid * 31 + c * 17) % 97 / 97.0::DOUBLE) AS e, CASE WHEN lab = c THEN 1 ELSE 0 END AS y FROM pts, (SELECT unnest([0, 1, 2, 3]) AS c)),
    k AS (SELECT *, sum(y) OVER (PARTITION BY class) AS g, sum(y) OVER w AS cu, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY class ORDER BY e DESC, pid ROWS UNBOUNDED PRECEDING)),
    j AS (SELECT class, e, k, 1 - (g - cu) / (g + k - cu) AS j FROM k WHERE g > 0), s AS (SELECT class, e, j - coalesce(lag(j) OVER (PARTITION BY class ORDER BY k), 0) AS step FROM j)
    SELECT CAST(class AS INTEGER) AS class, round(sum(step * e), 6) AS loss FROM s GROUP BY 1"""
)
def lovasz_loss(spark, d):
    rows = points(spark, d).select("pid", "lab", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("class"))
    y = (F.col("lab") == F.col("class")).cast("int")
    rows = rows.select("pid", "class", y.alias("y"), F.abs(y - F.pmod(F.col("pid") * 31 + F.col("class") * 17, F.lit(97)) / 97).alias("e"))
    return nn.lovasz_loss(rows, "pid", "e", "y", "class")


@query(
    f"""WITH l AS (SELECT pid, r, g, lab, {_LOGITS} FROM pts), h AS (SELECT *, [r % 3, g % 4, lab, 0, 1] AS h FROM l)
    SELECT round(sum({' + '.join(f'-ln(exp(l{i}) / ({_SUM})) * h[{i + 1}]' for i in range(N_LOGITS))}) / sum(list_sum(h)), 6) AS loss FROM h"""
)
def hist_loss(spark, d):
    h = F.array(*[c.cast("long") for c in (F.pmod("r", F.lit(3)), F.pmod("g", F.lit(4)), F.col("lab"), F.lit(0), F.lit(1))])
    return nn.histogram_loss(_logits(points(spark, d)).withColumn("h", h), "logits", "h")


@query("SELECT round(0.5 * avg(z) + 2 * avg(x), 6) AS loss FROM pts")
def combined_loss(spark, d):
    p = points(spark, d)
    return nn.combined_loss([(0.5, p.agg(F.avg("z").alias("loss"))), (2.0, p.agg(F.avg("x").alias("loss")))])


@query("SELECT pid, CASE WHEN lab = 1 AND obj < 20 THEN 4.0::DOUBLE WHEN lab = 1 THEN 3.0 WHEN obj < 20 THEN 2.0 ELSE 1.0 END AS w FROM pts")
def affinity_weights(spark, d):
    return points(spark, d).select("pid", nn.affinity_weights(F.col("lab") == 1, F.col("obj") < 20, (4.0, 3.0, 2.0, 1.0)).alias("w"))
