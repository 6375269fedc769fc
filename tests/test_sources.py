"""Readers over files made here, and streams."""

import json
import struct

from pyspark.sql import functions as F

from lattica.sources import clouds
from lattica.streaming.clouds import stream_pipeline


def _ply(path, element, kinds, rows, ascii_form=False):
    head = ["ply", f"format {'ascii' if ascii_form else 'binary_little_endian'} 1.0", f"element {element} {len(rows)}"]
    head += [f"property {kind} {name}" for name, kind in kinds.items()] + ["end_header"]
    codes = {"float": "f", "double": "d", "uchar": "B", "int": "i"}
    with open(path, "wb") as f:
        f.write(("\n".join(head) + "\n").encode())
        for r in rows:
            f.write((" ".join(map(str, r)) + "\n").encode() if ascii_form else struct.pack("<" + "".join(codes[k] for k in kinds.values()), *r))


def test_aerial_tile(spark, tmp_path):
    kinds = {"x": "float", "y": "float", "z": "float", "intensity": "float", "sem_class": "int", "ins_class": "int"}
    _ply(tmp_path / "a.ply", "testing", kinds, [(10, 20, 30, 30000, 1, 7), (11, 22, 33, 90000, 2, 8)])
    a, b = clouds.read_aerial_tiles(spark, str(tmp_path), {1: 0, 2: 5}).orderBy("row").collect()
    assert (a.x, a.y, a.z, a.intensity, a.label, a.obj) == (0, 0, 0, 0.5, 0, 7)
    assert (b.x, b.y, b.z, b.intensity, b.label) == (1, 2, 3, 1.0, 5)


def test_street_window_in_ascii_without_labels(spark, tmp_path):
    kinds = {"x": "float", "y": "float", "z": "float", "red": "uchar", "green": "uchar", "blue": "uchar"}
    _ply(tmp_path / "w.ply", "vertex", kinds, [(1, 2, 3, 255, 0, 51)], ascii_form=True)
    r = clouds.read_street_windows(spark, str(tmp_path)).first()
    assert (r.x, r.r, r.g, r.b, r.label, r.obj) == (1, 1, 0, 0.2, None, None)


def test_room_objects(spark, tmp_path):
    folder = tmp_path / "office_1" / "Annotations"
    folder.mkdir(parents=True)
    (folder / "chair_1.txt").write_text("1 2 3 255 0 0\n4 5 6 0 255 0\n")
    (folder / "stairs_1.txt").write_text("7 8 9 0 0 255\n")
    rows = clouds.read_room_objects(spark, str(tmp_path), {"chair": 3, "clutter": 12}).orderBy("x").collect()
    assert [(r.room, r.object, r.label, r.x) for r in rows] == [("office_1", "chair_1", 3, 1), ("office_1", "chair_1", 3, 4), ("office_1", "stairs_1", 12, 7)]


def test_labelled_scan(spark, tmp_path):
    (tmp_path / "seg.json").write_text(json.dumps({"segIndices": [5, 5, 6, 7]}))
    (tmp_path / "agg.json").write_text(json.dumps({"segGroups": [{"objectId": 0, "label": "chair", "segments": [5, 6]}, {"objectId": 1, "label": "desk", "segments": [6]}]}))
    (tmp_path / "map.tsv").write_text("raw_category\tnyu40id\nchair\t5\ndesk\t14\n")
    (tmp_path / "meta.txt").write_text("axisAlignment = 1 0 0 10 0 1 0 0 0 0 1 0 0 0 0 1\nother = 3\n")
    vertices = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(4)], "vertex int, x double, y double, z double")
    vertices = clouds.aligned(vertices, clouds.read_axis_alignment(spark, str(tmp_path / "meta.txt")))
    out = clouds.labelled_scan(vertices, clouds.read_segments(spark, str(tmp_path / "seg.json")), clouds.read_aggregation(spark, str(tmp_path / "agg.json")), clouds.read_label_map(spark, str(tmp_path / "map.tsv")))
    rows = {r.vertex: r for r in out.collect()}
    # segment 6 is in both groups and takes the later one
    assert [(rows[i].label, rows[i].object) for i in range(4)] == [(5, 1), (5, 1), (14, 2), (None, None)]
    assert rows[0].x == 10
    boxes = {r.object: r for r in clouds.instance_boxes(out).collect()}
    assert (boxes[1].cx, boxes[1].sx, boxes[1].label) == (10.5, 1.0, 5)


def test_stream_over_files(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("pid"), (F.col("id") % 3).cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    q = stream_pipeline(spark, str(tmp_path / "in"), df.schema, lambda b: b.groupBy("x").count(), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 20


def test_split_ranges_give_each_row_once(spark, tmp_path):
    """Binary and text files cut anywhere, more elements behind and before, absent properties."""
    from lattica.sources import splits

    rows = [(i, i / 8, i % 200) for i in range(5000)]
    kinds = {"a": "int", "b": "double", "c": "uchar"}
    _ply(tmp_path / "bin.ply", "vertex", kinds, rows)
    _ply(tmp_path / "text.ply", "vertex", kinds, rows[:3000], ascii_form=True)
    for size in (777, 9999, 1 << 20):
        out = splits.read_ply(spark, f"file://{tmp_path}", {"c": "c", "a": "a", "none": "none"}, range_bytes=size).collect()
        for name, n in (("bin.ply", 5000), ("text.ply", 3000)):
            own = sorted((r.row, r.a, r.c, r.none) for r in out if r.path.endswith(name))
            assert [x[1:] for x in own] == [(i, i % 200, None) for i in range(n)]
            assert name != "bin.ply" or [x[0] for x in own] == list(range(n))
    assert spark.read.format("ply").load(str(tmp_path / "bin.ply")).columns == ["path", "row", "a", "b", "c"]


def test_header_with_elements_before_and_after():
    from lattica.sources.splits import layout

    head = b"ply\nformat binary_big_endian 1.0\nelement camera 2\nproperty float f\nproperty uchar g\nelement vertex 7\nproperty short x\nelement face 3\nproperty list uchar int i\nend_header\n"
    at = layout(head, "vertex")
    assert (at.start, at.count, at.last, at.dtype.itemsize) == (len(head) + 10, 7, False, 2) and at.dtype.byteorder != "<"
    assert layout(head[:-1], "vertex") is None


def test_split_files_are_written_and_read_back(spark, tmp_path):
    from lattica.sources import splits

    df = spark.range(1000).select("id", (F.col("id") / 3).alias("x")).repartition(3)
    made = splits.write_ply(df, f"file://{tmp_path}/out", {"id": "int", "x": "double"}).collect()
    assert sum(r.n for r in made) == 1000
    back = splits.read_ply(spark, f"file://{tmp_path}/out", {"id": "id", "x": "x"}, range_bytes=128)
    assert sorted((int(r.id), r.x) for r in back.collect()) == [(i, i / 3) for i in range(1000)]


def test_area_with_angles(spark, tmp_path):
    for room, lines in {"office_1": "1 0 0 255 0 0\n3 0 2 x 0 0\n", "hall_2": "5 5 4 1 2 3\n"}.items():
        folder = tmp_path / "Area_5" / room / "Annotations"
        folder.mkdir(parents=True)
        (folder / "chair_1.txt").write_text(lines)
        (folder / "wall_3 (1).txt").write_text("9 9 9 9 9 9\n")
    (tmp_path / "Area_5" / "Area_5_alignmentAngle.txt").write_text("## header\n## second\noffice_1 90\n")
    rows = clouds.read_area(spark, str(tmp_path / "Area_5"), {"chair": 7, "clutter": 12}, held=("hall_2",), align=True, room_position=True).collect()
    got = sorted((r.room, r.obj, round(r.x, 9), round(r.y, 9), r.r, r.label, r.is_val, r.room_z) for r in rows)
    # x goes to -y at 90 degrees; a room without an angle stays; the second copy of a wall is left out; a bad colour is 0
    assert got == [("hall_2", 0, 5, 5, 1 / 255, 7, True, 1), ("office_1", 1, 0, -3, 0, 7, False, 1), ("office_1", 1, 0, -1, 1, 7, False, 0)]
    assert sorted(round(r.room_y, 9) for r in rows if r.room == "office_1") == [0, 1]
