"""Readers: points written as the files of public collections in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog, clouds, splits
from ..storage import shared_dir
from .fixtures import CLASSES, points, query, segments


def _ply(spark, d, kinds, element="vertex", text=False, **columns):
    """The path of points written as PLY files, whose columns are expressions."""
    path = shared_dir(spark)
    rows = points(spark, d).select(*[F.expr(v).alias(k) for k, v in columns.items()])
    splits.write_ply(rows, path, kinds, element, text).agg(F.sum("n")).first()
    return path


@query("SELECT pid, x, round(y, 6) AS y, round(z, 6) AS z, CAST(lab AS INTEGER) AS lab FROM pts")
def ply_points(spark, d):
    kinds = {"pid": "int", "x": "double", "y": "double", "z": "double", "lab": "uchar", "unread": "float"}
    path = _ply(spark, d, kinds, pid="pid", x="x", y="y", z="z", lab="lab", unread="x + y")
    rows = splits.read_ply(spark, path, {c: c for c in ("pid", "x", "y", "z", "lab")}, range_bytes=1 << 16)
    return rows.select(F.col("pid").cast("long").alias("pid"), "x", "y", "z", F.col("lab").cast("int").alias("lab"))


@query("SELECT pid, round(y, 6) AS y FROM pts")
def ply_text_points(spark, d):
    path = _ply(spark, d, {"pid": "int", "y": "double"}, text=True, pid="pid", y="y")
    return splits.read_ply(spark, path, {"pid": "pid", "y": "y"}, range_bytes=1 << 14).select(F.col("pid").cast("long").alias("pid"), "y")


_TILE = " ".join(f"WHEN {raw} THEN {label}" for raw, label in catalog.DALES.labels.items())


@query(f"SELECT x, round(y, 6) AS y, round(z, 6) AS z, round(least(pid * 7, 60000) / 60000, 6) AS intensity, CAST(CASE lab WHEN 0 THEN 8 ELSE coalesce(CASE lab {_TILE} END, 8) END AS INTEGER) AS label, obj FROM pts")
def aerial_tile_points(spark, d):
    kinds = {"x": "double", "y": "double", "z": "double", "intensity": "float", "sem_class": "int", "ins_class": "int"}
    path = _ply(spark, d, kinds, "testing", x="x", y="y", z="z", intensity="pid * 7", sem_class="lab", ins_class="obj")
    rows = clouds.read_aerial_tiles(spark, path, catalog.DALES.labels)
    back = {c: F.col(c) + F.col(f"offset_{c}") for c in "xyz"}
    return rows.select(*[v.alias(k) for k, v in back.items()], "intensity", F.coalesce("label", F.lit(catalog.DALES.void)).alias("label"), "obj")


_STREET = " ".join(f"WHEN {raw} THEN {label}" for raw, label in catalog.KITTI360.labels.items())


@query(f"SELECT x, round(y, 6) AS y, round(r / 255, 6) AS r, round(g / 255, 6) AS g, CAST(CASE lab + 5 {_STREET} END AS INTEGER) AS label, obj FROM pts")
def street_window_points(spark, d):
    kinds = {"x": "double", "y": "double", "z": "double", "red": "uchar", "green": "uchar", "blue": "uchar", "semantic": "int", "instance": "int"}
    path = _ply(spark, d, kinds, x="x", y="y", z="z", red="r", green="g", blue="b", semantic="lab + 5", instance="obj")
    return clouds.read_street_windows(spark, path, catalog.KITTI360.labels).select("x", "y", "r", "g", "label", "obj")


#: Rooms of the fixture: the first few segments' columns, one object for each label; angles in degrees.
ROOMS, ANGLES = 8, (0.0, 90.0, 180.0, 270.0, 30.0)
_ROOM = "CAST(trunc(x / 20) AS BIGINT) % 8"
_NAMES = ("chair", "table", "wall", "stairs", "door")


def _area(spark, d):
    """The path of an area whose rooms are slices of the points."""
    path = shared_dir(spark)
    room = F.concat(F.lit("office_"), (F.col("super_index") / 1000).cast("long") % ROOMS)
    kind = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.col("lab") + 1)
    rows = segments(spark, d).select(F.lit("Area_1").alias("area"), room.alias("room"), F.concat(kind, F.lit("_"), F.col("lab") + 1).alias("object"), *"xyz", *"rgb")
    angles = {f"Area_1/office_{i}": ANGLES[i % len(ANGLES)] for i in range(ROOMS - 1)}  # one room has no angle
    clouds.write_rooms(rows, path, angles).agg(F.sum("n")).first()
    return path


_CLASS = {n: i for i, n in enumerate(catalog.S3DIS_CLASSES)}
_AREA = f"""a AS (SELECT *, {_ROOM} AS k, {list(_NAMES)}[lab + 1] AS kind FROM pts), b AS (SELECT *, 'office_' || k AS room, kind || '_' || (lab + 1) AS object,
radians(CASE WHEN k = {ROOMS - 1} THEN 0 ELSE {list(ANGLES)}[k % {len(ANGLES)} + 1] END) AS w FROM a),
c AS (SELECT *, cos(w) * x + sin(w) * y AS u, cos(w) * y - sin(w) * x AS v, dense_rank() OVER (ORDER BY room, object) - 1 AS oid,
CASE kind {' '.join(f"WHEN '{n}' THEN {_CLASS[n]}" for n in _NAMES if n in _CLASS)} ELSE {_CLASS['clutter']} END AS label FROM b)"""


@query(f"WITH {_AREA} SELECT room, object, oid AS obj, round(u, 6) AS x, round(v, 6) AS y, round(z, 6) AS z, round(r / 255, 6) AS r, round(g / 255, 6) AS g, round(b / 255, 6) AS b, CAST(label AS INTEGER) AS label, room = 'office_1' AS is_val FROM c")
def area_points(spark, d):
    return clouds.read_area(spark, f"{_area(spark, d)}/Area_1", _CLASS, held=("office_1",), align=True)


@query(
    f"""WITH {_AREA}, m AS (SELECT room, min(u) AS lu, min(v) AS lv, max(u) AS hu, max(v) AS hv, max(z) AS hz FROM c GROUP BY 1)
    SELECT room, object, round(x, 6) AS x, round((u - lu) / (hu - lu), 6) AS room_x, round((v - lv) / (hv - lv), 6) AS room_y, round(z / hz, 6) AS room_z FROM c JOIN m USING (room)"""
)
def area_room_positions(spark, d):
    return clouds.read_area(spark, f"{_area(spark, d)}/Area_1", _CLASS, room_position=True).select("room", "object", "x", "room_x", "room_y", "room_z")
