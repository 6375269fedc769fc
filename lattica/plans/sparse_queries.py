"""Sparse convolutions over the voxels of the points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sparse
from ..operators.voxels import with_cells
from .fixtures import points, query


def _weights(places, outs, ins):
    """Weights by a rule that SQL can follow."""
    return [[[((k * 7 + o * 3 + i * 5) % 11 - 5) / 10 for i in range(ins)] for o in range(outs)] for k in range(places)]


def _conv(channels, ins):
    return ", ".join("sum(" + " + ".join(f"((k * 7 + {o * 3 + i * 5}) % 11 - 5) / 10 * x{i}" for i in range(ins)) + f") AS y{o}" for o in range(channels))


def _normed(name, channels, norm):
    """Channels of a table normalised over all its rows, then rectified."""
    parts = [f"greatest(0, (y{o} - avg(y{o}) OVER ()) / sqrt(var_pop(y{o}) OVER () + 1e-5) * {norm[0][o]}::DOUBLE + {norm[1][o]}::DOUBLE) AS x{o}" for o in range(channels)]
    return f"SELECT cx, cy, cz, {', '.join(parts)} FROM {name}"


NORMS = ([1.5, 0.5, -1.0], [0.1, 0.0, -0.2]), ([0.8, 1.2], [0.05, 0.3])
BLOCKS = [
    sparse.ConvBlock(_weights(27, 3, 2), norm=NORMS[0]),
    sparse.ConvBlock(_weights(27, 2, 3), norm=NORMS[1]),
    sparse.ConvBlock(_weights(8, 2, 2), bias=[0.5, -0.5], size=2, stride=2, slope=None),
]
_CELLS = """c0 AS (SELECT cx, cy, cz, count(*) / 10 AS x0, avg(z) / 100 AS x1 FROM vox GROUP BY ALL),
kn AS (SELECT a AS ox, b AS oy, c AS oz, (a + 1) * 9 + (b + 1) * 3 + c + 1 AS k FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c))"""
_STACK = f"""{_CELLS}, y1 AS (SELECT t.cx, t.cy, t.cz, {_conv(3, 2).replace("x0", "s.x0").replace("x1", "s.x1")} FROM c0 t, kn JOIN c0 s ON s.cx = t.cx + ox AND s.cy = t.cy + oy AND s.cz = t.cz + oz GROUP BY ALL),
c1 AS ({_normed("y1", 3, NORMS[0])}),
y2 AS (SELECT t.cx, t.cy, t.cz, {_conv(2, 3).replace("x0", "s.x0").replace("x1", "s.x1").replace("x2", "s.x2")} FROM c1 t, kn JOIN c1 s ON s.cx = t.cx + ox AND s.cy = t.cy + oy AND s.cz = t.cz + oz GROUP BY ALL),
c2 AS ({_normed("y2", 2, NORMS[1])})"""


def _cells(spark, d):
    """Voxels with two channels, known by their least point."""
    rows = with_cells(points(spark, d), (10.0, 10.0, 10.0)).groupBy("cx", "cy", "cz")
    return rows.agg(F.min("pid").alias("id"), F.array(F.count(F.lit(1)) / 10, F.avg("z") / 100).alias("x"))


def _placed(features, cells):
    return cells.join(features, "id").select("cx", "cy", "cz", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(2)])


@query(f"WITH {_STACK} SELECT cx, cy, cz, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM c2", "vox")
def sparse_cnn(spark, d):
    return _placed(*sparse.cnn(_cells(spark, d), BLOCKS[:2]))


@query(
    f"""WITH {_STACK}, s AS (SELECT *, CAST(floor(cx / 2) AS BIGINT) AS ux, CAST(floor(cy / 2) AS BIGINT) AS uy, CAST(floor(cz / 2) AS BIGINT) AS uz FROM c2),
    y3 AS (SELECT ux, uy, uz, {_conv(2, 2)} FROM (SELECT *, (cx - 2 * ux) * 4 + (cy - 2 * uy) * 2 + cz - 2 * uz AS k FROM s) GROUP BY ALL)
    SELECT ux AS cx, uy AS cy, uz AS cz, round(y0 + 0.5, 6) AS x0, round(y1 - 0.5, 6) AS x1 FROM y3""",
    "vox",
)
def sparse_cnn_strided(spark, d):
    return _placed(*sparse.cnn(_cells(spark, d), BLOCKS))
