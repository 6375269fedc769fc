"""Forward passes over segments: points, their segments, and the segments' own groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, network
from .fixtures import edges, points, query, segment_edges, segment_nodes, segments

BLOCK = network.Block(
    ([[0.5, -0.25], [0.25, 0.75]], [0.1, -0.2]),
    ([[-0.5, 0.5], [0.75, 0.25]], [0.0, 0.3]),
    ([[1.0, 0.5], [-0.5, 1.0]], [0.2, 0.1]),
    ([[0.6, -0.4], [0.3, 0.9]], [0.05, -0.05]),
    [([[0.7, 0.2], [-0.3, 0.8], [0.5, -0.6]], [0.1, 0.0, -0.1]), ([[0.4, 0.3, -0.2], [-0.1, 0.6, 0.5]], [0.0, 0.2])],
)
NARROW = ([[0.5, 0.25, -0.5, 0.3], [-0.2, 0.7, 0.4, 0.6]], [0.1, -0.1])
FIRST = network.Stage([([[0.8, -0.3], [0.35, 0.65]], [0.05, 0.15])])
DOWN = network.Stage([NARROW], [BLOCK])
#: Two heads of width two, with terms from two edge features: of k for each head, of q for both heads at once, of v.
HEADS = network.Block(
    ([[0.5, -0.25], [0.25, 0.75], [-0.3, 0.4], [0.6, 0.1]], [0.1, -0.2, 0.05, 0.0]),
    ([[-0.5, 0.5], [0.75, 0.25], [0.2, 0.9], [-0.4, 0.3]], [0.0, 0.3, -0.1, 0.2]),
    ([[1.0, 0.5], [-0.5, 1.0], [0.3, -0.7], [0.8, 0.2]], [0.2, 0.1, 0.0, -0.3]),
    ([[0.6, -0.4, 0.2, 0.1], [0.3, 0.9, -0.5, 0.4]], [0.05, -0.05]),
    BLOCK.ffn,
    2,
    {"k": ([[0.3, -0.6], [0.2, 0.5], [-0.1, 0.4], [0.7, 0.0]], [0.1, 0.0, -0.2, 0.05]), "q": ([[0.4, 0.1], [-0.3, 0.2]], [0.0, 0.1]), "v": ([[0.5, 0.5], [-0.2, 0.1], [0.3, -0.4], [0.0, 0.6]], [0.0, 0.2, -0.1, 0.0])},
    "d.g",
)
HEAD = ([[1.0, -0.5], [0.25, 0.75], [-0.6, 0.4]], [0.0, 0.1, -0.1])


def _lin(cols, layer, to, leaky=False):
    """A linear layer as a select list."""
    sums = [" + ".join(f"({c}) * {v}::DOUBLE" for c, v in zip(cols, row)) + f" + {b}::DOUBLE" for row, b in zip(*layer)]
    return ", ".join(f"{f'CASE WHEN {s} < 0 THEN ({s}) * 0.01::DOUBLE ELSE {s} END' if leaky else s} AS {to}{i}" for i, s in enumerate(sums))


def _norm(p, src):
    return f"""{p}s AS (SELECT g, avg(v) AS m, var_pop(v) AS v FROM (SELECT g, x0 AS v FROM {src} UNION ALL SELECT g, x1 FROM {src}) GROUP BY 1),
    {p}n AS (SELECT id, (x0 - m) / sqrt(v + 1e-5) AS n0, (x1 - m) / sqrt(v + 1e-5) AS n1 FROM {src} JOIN {p}s USING (g)),"""


def _block(p, src, links):
    """A block from a table (id, up, g, x0, x1) to `{p}`; no attention where links is None."""
    sql = ""
    if links:
        qkv = ", ".join(_lin(("n0", "n1"), getattr(BLOCK, n), n) for n in "qkv")
        out = _lin(("coalesce(v0, 0)", "coalesce(v1, 0)"), BLOCK.out, "y")
        sql = f"""{_norm(p + "a", src)} {p}q AS (SELECT id, {qkv} FROM {p}an),
        {p}e AS (SELECT e.s AS id, exp((a.q0 * b.k0 + a.q1 * b.k1) / sqrt(2)) AS w, b.v0, b.v1 FROM {links} e JOIN {p}q a ON a.id = e.s JOIN {p}q b ON b.id = e.t),
        {p}w AS (SELECT id, sum(w * v0) / sum(w) AS v0, sum(w * v1) / sum(w) AS v1 FROM {p}e GROUP BY 1),
        {p}r AS (SELECT id, up, g, x0 + y0 AS x0, x1 + y1 AS x1 FROM (SELECT id, up, g, x0, x1, {out} FROM {src} LEFT JOIN {p}w USING (id))),"""
        src = f"{p}r"
    hidden, last = _lin(("n0", "n1"), BLOCK.ffn[0], "h", True), _lin(("h0", "h1", "h2"), BLOCK.ffn[1], "y")
    return f"""{sql} {_norm(p + "f", src)} {p}h AS (SELECT id, {hidden} FROM {p}fn),
    {p} AS (SELECT id, up, g, x0 + y0 AS x0, x1 + y1 AS x1 FROM {src} JOIN (SELECT id, {last} FROM {p}h) USING (id)),"""


def _heads(p, src, links):
    """The attention of HEADS from a table (id, up, g, x0, x1), over links (s, t, a0, a1), to `{p}r`."""
    qkv = ", ".join(_lin(("n0", "n1"), getattr(HEADS, n), n) for n in "qkv")
    terms = ", ".join(_lin(("a0", "a1"), HEADS.rpe[n], f"r{n}") for n in "kqv")
    score = [" + ".join(f"(q{2 * h + j} / sqrt(2 * deg) + rq{j}) * (k{2 * h + j} + rk{2 * h + j})" for j in range(2)) for h in range(2)]
    sums = ", ".join(f"sum(w{i // 2} * (v{i} + rv{i})) / sum(w{i // 2}) AS v{i}" for i in range(4))
    out = _lin([f"coalesce(v{i}, 0)" for i in range(4)], HEADS.out, "y")
    return f"""{_norm(p + "a", src)} {p}q AS (SELECT id, {qkv} FROM {p}an),
    {p}l AS (SELECT *, count(*) OVER (PARTITION BY s) AS deg, {terms} FROM {links}),
    {p}e AS (SELECT l.s AS id, {", ".join(f"a.q{i}" for i in range(4))}, {", ".join(f"b.k{i}, b.v{i}" for i in range(4))}, l.* FROM {p}l l JOIN {p}q a ON a.id = l.s JOIN {p}q b ON b.id = l.t),
    {p}w AS (SELECT id, {sums} FROM (SELECT *, exp({score[0]}) AS w0, exp({score[1]}) AS w1 FROM {p}e) GROUP BY 1),
    {p}r AS (SELECT id, up, g, x0 + y0 AS x0, x1 + y1 AS x1 FROM (SELECT id, up, g, x0, x1, {out} FROM {src} LEFT JOIN {p}w USING (id))),"""


def _fused(p, own, other, key):
    """Two tables' features side by side, through the narrow layer."""
    return f"{p} AS (SELECT o.id, o.up, o.g, {_lin(('o.x0', 'o.x1', 'c.x0', 'c.x1'), NARROW, 'x', True)} FROM {own} o JOIN {other} c ON c.id = o.{key}),"


_POINTS = "p0 AS (SELECT pid AS id, super_index AS up, CAST(trunc(super_index / 1000) AS BIGINT) AS g, x / 100 AS x0, y / 500 AS x1 FROM seg),"
_SEGMENTS = "l1 AS (SELECT id, CAST(trunc(id / 1000) AS BIGINT) AS up, CAST(trunc(id / 1000) AS BIGINT) AS g, z / 100 AS x0, log_size AS x1 FROM snode),"
_LINKS = "links AS (SELECT s, t FROM sedge UNION ALL SELECT t, s FROM sedge),"
_TOP = "l2 AS (SELECT up AS id, NULL AS up, up AS g, avg(x0) AS x0, avg(x1) AS x1 FROM l1 GROUP BY up),"


def _pool(p, src):
    return f"{p} AS (SELECT up AS id, max(x0) AS x0, max(x1) AS x1 FROM {src} GROUP BY 1),"


_FIRST = f"f0 AS (SELECT id, up, g, {_lin(('x0', 'x1'), FIRST.before[0], 'x', True)} FROM p0),"
_DOWN1 = f"{_POINTS} {_SEGMENTS} {_LINKS} {_FIRST} {_pool('c1', 'f0')} {_fused('d1', 'l1', 'c1', 'id')} {_block('b1', 'd1', 'links')}"
_UNET = f"{_DOWN1} {_TOP} {_pool('c2', 'b1')} {_fused('d2', 'l2', 'c2', 'id')} {_block('b2', 'd2', None)} {_fused('u1', 'b1', 'b2', 'up')} {_block('b3', 'u1', 'links')}"
_OUT = "round(x0, 6) AS x0, round(x1, 6) AS x1"


def _levels(spark, d):
    top = (F.col("super_index") / 1000).cast("long")
    p = segments(spark, d).select(F.col("pid").alias("id"), "super_index", top.alias("graph"), F.array(F.col("x") / 100, F.col("y") / 500).alias("x"))
    own = (F.col("id") / 1000).cast("long")
    s = segment_nodes(spark, d).select("id", own.alias("super_index"), own.alias("graph"), (F.col("z") / 100).alias("a"), F.col("log_size").alias("b"))
    t = s.groupBy(F.col("super_index").alias("id")).agg(F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("graph", F.col("id"))
    s, t = (n.withColumn("x", F.array("a", "b")).drop("a", "b") for n in (s, t))
    return [p, s, t], [None, graph.both_directions(segment_edges(spark, d).select("s", "t")), None]


def _places(df):
    return df.select("id", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(2)])


@query(
    f"""WITH p0 AS (SELECT pid AS id, NULL AS up, lab AS g, x / 100 AS x0, y / 500 AS x1 FROM pts), {_block("b", "p0", "adj")} o AS (SELECT * FROM b)
    SELECT id, {_OUT} FROM o""",
    "adj",
)
def transformer_block(spark, d):
    p = points(spark, d).select(F.col("pid").alias("id"), F.col("lab").alias("graph"), F.array(F.col("x") / 100, F.col("y") / 500).alias("x"))
    return _places(network.transformer_block(p, edges(spark, d), BLOCK))


@query(
    f"""WITH p0 AS (SELECT pid AS id, NULL AS up, lab AS g, x / 100 AS x0, y / 500 AS x1 FROM pts), le AS (SELECT s, t, d / 4 AS a0, d * d / 16 AS a1 FROM adj),
    {_heads("b", "p0", "le")} {_block("f", "br", None)} o AS (SELECT * FROM f) SELECT id, {_OUT} FROM o""",
    "adj",
)
def transformer_block_heads(spark, d):
    p = points(spark, d).select(F.col("pid").alias("id"), F.col("lab").alias("graph"), F.array(F.col("x") / 100, F.col("y") / 500).alias("x"))
    e = edges(spark, d).select("s", "t", F.array(F.col("d") / 4, F.col("d") * F.col("d") / 16).alias("a"))
    return _places(network.transformer_block(p, e, HEADS))


@query(f"WITH {_DOWN1} o AS (SELECT * FROM b1) SELECT id, {_OUT} FROM o", "sedge snode")
def down_stage(spark, d):
    n, e = _levels(spark, d)
    return _places(network.down_stage(n[1], network.stage(n[0], None, FIRST), e[1], DOWN))


@query(f"WITH {_UNET} o AS (SELECT * FROM b3) SELECT id, {_OUT} FROM o", "sedge snode")
def unet_forward(spark, d):
    n, e = _levels(spark, d)
    return _places(network.unet(n, e, FIRST, [DOWN, DOWN], [DOWN]))


@query(
    f"""WITH {_UNET} k AS (SELECT id, {_lin(("x0", "x1"), HEAD, "l")} FROM b3)
    SELECT id, CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS INTEGER) AS label, round(exp(greatest(l0, l1, l2)) / (exp(l0) + exp(l1) + exp(l2)), 6) AS score FROM k""",
    "sedge snode",
)
def unet_classes(spark, d):
    n, e = _levels(spark, d)
    return network.classify(network.unet(n, e, FIRST, [DOWN, DOWN], [DOWN]), HEAD)


def _injected(mode, *args):
    def run(spark, d):
        rows = points(spark, d).select(F.col("pid").alias("id"), F.array(F.log(F.col("z") + 2), F.sqrt("x")).alias("x"), F.array(F.sin("y"), F.cos("y")).alias("pos"))
        out = network.inject(rows, mode, "x", "pos", *args)
        return out.select("id", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(4 if mode == "cat" else 2)])

    run.__name__ = f"inject_{mode}"
    a, p = ("ln(z + 2)", "sqrt(x)"), ("sin(y)", "cos(y)")
    hidden = f"SELECT pid, x, z, {_lin(p, BLOCK.ffn[0], 'h', True)} FROM pts"
    sql = {
        "cat": "SELECT pid AS id, " + ", ".join(f"round({c}, 6) AS x{i}" for i, c in enumerate(p + a)) + " FROM pts",
        "add": "SELECT pid AS id, " + ", ".join(f"round({c} + {v}, 6) AS x{i}" for i, (c, v) in enumerate(zip(p, a))) + " FROM pts",
        "add_mlp": f"SELECT pid AS id, round(y0 + {a[0]}, 6) AS x0, round(y1 + {a[1]}, 6) AS x1 FROM (SELECT pid, x, z, {_lin(('h0', 'h1', 'h2'), BLOCK.ffn[1], 'y')} FROM ({hidden}))",
    }[mode]
    return query(sql)(run)


inject_cat, inject_add, inject_add_mlp = _injected("cat"), _injected("add"), _injected("add_mlp", BLOCK.ffn)
