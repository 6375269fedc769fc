"""Readers of raw point clouds: PLY, space-separated text, JSON segments, TSV label maps.

Files are listed and read by Spark; a PLY file of any size is read by many tasks (`splits`).
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import dense_ids
from .splits import read_ply


def read_aerial_tiles(spark: SparkSession, path: str, remap: dict[int, int] | None = None) -> DataFrame:
    """Tiles with intensity (clipped to 60000, then 0..1), sem_class and ins_class; positions relative to each tile's first point."""
    rows = read_ply(spark, path, {"x": "x", "y": "y", "z": "z", "intensity": "intensity", "y_raw": "sem_class", "obj": "ins_class"}, "testing")
    first = rows.where("row = 0").select("path", *[F.col(d).alias(f"offset_{d}") for d in "xyz"])
    rows = rows.join(first, "path").withColumns({d: F.col(d) - F.col(f"offset_{d}") for d in "xyz"})
    rows = rows.withColumn("intensity", F.greatest(F.lit(0.0), F.least(F.lit(60000.0), "intensity")) / 60000)
    return rows.withColumn("label", remapped(F.col("y_raw").cast("int"), remap)).drop("y_raw").withColumn("obj", F.col("obj").cast("long"))


def read_street_windows(spark: SparkSession, path: str, remap: dict[int, int] | None = None) -> DataFrame:
    """Windows with colours in 0..1 and, where the files have them, semantic and instance labels."""
    rows = read_ply(spark, path, {"x": "x", "y": "y", "z": "z", "r": "red", "g": "green", "b": "blue", "s": "semantic", "obj": "instance"})
    rows = rows.withColumns({c: F.col(c) / 255 for c in "rgb"})
    return rows.withColumn("label", remapped(F.col("s").cast("int"), remap)).drop("s").withColumn("obj", F.col("obj").cast("long"))


def remapped(label, table: dict[int, int] | None):
    if not table:
        return label
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), label)


def read_room_objects(spark: SparkSession, path: str, classes: dict[str, int], other: str = "clutter") -> DataFrame:
    """(room, object, x, y, z, r, g, b, label): one text file per object, whose class begins the file name."""
    schema = ", ".join(f"{c} double" for c in ("x", "y", "z", "r", "g", "b"))
    rows = spark.read.schema(schema).option("sep", " ").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_*.txt").csv(path)
    name = F.input_file_name()
    kind = F.regexp_extract(name, r"([^/_]+)_\d+\.txt$", 1)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), kind), F.lit(classes[other]))
    room = F.regexp_extract(name, r"([^/]+)/Annotations/[^/]+$", 1)
    return rows.select(room.alias("room"), F.regexp_extract(name, r"([^/]+)\.txt$", 1).alias("object"), *["x", "y", "z"], *[(F.col(c) / 255).alias(c) for c in "rgb"], label.alias("label"))


def read_alignment_angles(spark: SparkSession, path: str) -> DataFrame:
    """(room, angle) in degrees, from the lines `room angle` of all files `*_alignmentAngle.txt` under a path."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_alignmentAngle.txt").text(path)
    part = lambda k: F.regexp_extract("value", r"^([A-Za-z]\S*)\s+(-?\d+(?:\.\d+)?)\s*$", k)
    return lines.where(part(1) != "").select(part(1).alias("room"), part(2).cast("double").alias("angle")).dropDuplicates(["room"])


def read_area(spark: SparkSession, path: str, classes: dict[str, int], other: str = "clutter", held: tuple[str, ...] = (), align: bool = False, room_position: bool = False) -> DataFrame:
    """(room, object, obj, x, y, z, r, g, b, label, is_val): all rooms of an area by one scan over their object files.

    obj numbers the objects of all rooms by room and name; is_val: whether the room is one of `held`; a colour that can't be
    read is 0. With `align`, each room is turned about z into its canonical orientation, by its angle in the area's side file;
    rooms without an angle stay as they are. `room_position` adds room_x, room_y and room_z: the place in the room, x and y from
    its low side and all three over the room's greatest, in its canonical orientation.
    """
    rows = read_room_objects(spark, path, classes, other).where(F.col("object").rlike(r"_\d+$"))
    rows = dense_ids(rows, ["room", "object"], "obj").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in "rgb"})
    rows = rows.withColumn("is_val", F.col("room").isin(list(held)))
    names = ["room", "object", "obj", *"xyz", *"rgb", "label", "is_val"]
    if not align and not room_position:
        return rows.select(*names)
    rows = rows.join(read_alignment_angles(spark, path), "room", "left")
    turn = F.radians(F.coalesce("angle", F.lit(0.0)))
    rows = rows.withColumns({"_x": F.cos(turn) * F.col("x") + F.sin(turn) * F.col("y"), "_y": F.cos(turn) * F.col("y") - F.sin(turn) * F.col("x")})
    if room_position:
        box = rows.groupBy("room").agg(F.min("_x").alias("_lx"), F.min("_y").alias("_ly"), F.max("_x").alias("_hx"), F.max("_y").alias("_hy"), F.max("z").alias("_hz"))
        rows = rows.join(box, "room")
        over = lambda a, b: F.try_divide(a, b)
        rows = rows.withColumns({"room_x": over(F.col("_x") - F.col("_lx"), F.col("_hx") - F.col("_lx")), "room_y": over(F.col("_y") - F.col("_ly"), F.col("_hy") - F.col("_ly")), "room_z": over(F.col("z"), F.col("_hz"))})
        names += ["room_x", "room_y", "room_z"]
    return (rows.withColumns({"x": F.col("_x"), "y": F.col("_y")}) if align else rows).select(*names)


def write_rooms(points: DataFrame, path: str, angles: dict[str, float] | None = None) -> DataFrame:
    """Writes points (area, room, object, x, y, z, r, g, b) as `area/room/Annotations/object.txt`; gives (object file, n).

    One task holds one object. angles (`area/room` -> degrees) become each area's side file.
    """

    def run(table: pa.Table) -> pa.Table:
        area, room, name = (table.column(c)[0].as_py() for c in ("area", "room", "object"))
        store, inner = fs.FileSystem.from_uri(path)
        folder = f"{inner.rstrip('/')}/{area}/{room}/Annotations"
        store.create_dir(folder, recursive=True)
        lines = zip(*[table.column(c).to_pylist() for c in ("x", "y", "z", "r", "g", "b")])
        with store.open_output_stream(f"{folder}/{name}.txt") as f:
            f.write("".join(f"{x!r} {y!r} {z!r} {r} {g} {b}\n" for x, y, z, r, g, b in lines).encode())
        return pa.table({"file": [f"{area}/{room}/{name}"], "n": pa.array([table.num_rows], pa.int64())})

    store, inner = fs.FileSystem.from_uri(path)
    by_area: dict[str, list[str]] = {}
    for place, angle in (angles or {}).items():
        area, room = place.split("/")
        by_area.setdefault(area, []).append(f"{room} {angle:g}\n")
    for area, lines in by_area.items():
        store.create_dir(f"{inner.rstrip('/')}/{area}", recursive=True)
        with store.open_output_stream(f"{inner.rstrip('/')}/{area}/{area}_alignmentAngle.txt") as f:
            f.write(("## Global alignment angle per disjoint space\n## room angle in degrees\n" + "".join(lines)).encode())
    whole = points.select("area", "room", "object", *[F.col(d).cast("double").alias(d) for d in "xyz"], *[F.col(c).cast("int").alias(c) for c in "rgb"])
    return whole.groupBy("area", "room", "object").applyInArrow(run, "file string, n long")


def read_label_map(spark: SparkSession, path: str, source: str = "raw_category", target: str = "nyu40id") -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col(source).alias("name"), F.col(target).cast("int").alias("label"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, segment) from a JSON file with segIndices."""
    rows = spark.read.option("multiLine", True).schema("segIndices array<long>").json(path)
    return rows.select(F.posexplode("segIndices").alias("vertex", "segment"))


def read_aggregation(spark: SparkSession, path: str) -> DataFrame:
    """(object, name, segment) from a JSON file with segGroups; objects count from 1, `place` is the group's."""
    rows = spark.read.option("multiLine", True).schema("segGroups array<struct<objectId: long, label: string, segments: array<long>>>").json(path)
    groups = rows.select(F.posexplode("segGroups").alias("place", "g"))
    return groups.select("place", (F.col("g.objectId") + 1).alias("object"), F.col("g.label").alias("name"), F.explode("g.segments").alias("segment"))


def read_axis_alignment(spark: SparkSession, path: str) -> DataFrame:
    """One row with a 16-number array, from the line `axisAlignment = ...`."""
    lines = spark.read.text(path).where(F.col("value").startswith("axisAlignment"))
    return lines.select(F.transform(F.split(F.trim(F.split("value", "=")[1]), r"\s+"), lambda v: v.cast("double")).alias("matrix"))


def aligned(points: DataFrame, matrix: DataFrame) -> DataFrame:
    m = lambda r, c: F.get("matrix", F.lit(4 * r + c))
    out = points.crossJoin(F.broadcast(matrix))
    return out.withColumns({d: m(i, 0) * F.col("x") + m(i, 1) * F.col("y") + m(i, 2) * F.col("z") + m(i, 3) for i, d in enumerate("xyz")}).drop("matrix")


def labelled_scan(vertices: DataFrame, segments: DataFrame, aggregation: DataFrame, labels: DataFrame) -> DataFrame:
    """`vertices` (vertex, ...) with label and object; a segment under several groups takes the last."""
    named = aggregation.join(F.broadcast(labels), "name", "left")
    per = named.groupBy("segment").agg(F.max_by("label", "place").alias("label"), F.max_by("object", "place").alias("object"))
    return vertices.join(segments, "vertex", "left").join(per, "segment", "left").drop("segment")


def instance_boxes(points: DataFrame) -> DataFrame:
    """(object, label, centre and size of the bounding box)."""
    return points.where("object is not null").groupBy("object").agg(
        F.min("label").alias("label"), *[((F.min(d) + F.max(d)) / 2).alias(f"c{d}") for d in "xyz"], *[(F.max(d) - F.min(d)).alias(f"s{d}") for d in "xyz"]
    )


def tile_ids(clouds: DataFrame, nx: int, ny: int) -> DataFrame:
    """(cloud_id): each cloud's tiles, named <cloud>__TILE_<i>-<j>_OF_<nx>-<ny>, counted from 1."""
    i, j = F.explode(F.sequence(F.lit(1), F.lit(nx))), F.explode(F.sequence(F.lit(1), F.lit(ny)))
    rows = clouds.withColumn("i", i).withColumn("j", j)
    return rows.select(F.format_string(f"%s__TILE_%d-%d_OF_{nx}-{ny}", "cloud_id", "i", "j").alias("cloud_id"))


def parsed_tiles(ids: DataFrame) -> DataFrame:
    """(cloud_id, base, i, j) with tile places from 0; a name without a tile keeps its whole as base."""
    p = r"^(.*)__TILE_(\d+)-(\d+)_OF_(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract("cloud_id", p, k)
    has = F.col("cloud_id").rlike(p)
    return ids.select("cloud_id", F.when(has, part(1)).otherwise(F.col("cloud_id")).alias("base"), *[F.when(has, part(k).cast("int") - 1).alias(n) for k, n in ((2, "i"), (3, "j"))])
