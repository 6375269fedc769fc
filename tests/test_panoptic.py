"""Sweeps over settings: each setting comes out as if it ran alone."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import instances, metrics, panoptic, partition


@pytest.fixture(scope="module")
def scene(spark):
    """Nodes in three clumps, with offsets, logits and overlaps."""
    rng = random.Random(8)
    nodes, overlaps, edges = [], [], []
    for i in range(36):
        clump, label = i % 3, (i % 3) if i % 7 else 2
        logits = [rng.random() + (2.0 if k == label else 0.0) for k in range(3)]
        nodes.append((i, rng.randint(1, 9), [clump * 5 + rng.random(), rng.random()], [0.1, -0.1], logits, i % 2))
        overlaps += [(i, clump if i % 5 else 7, rng.randint(1, 5), clump), (i, 9, 1, 3)]
        edges += [(i, j, 3.0 - (4.0 if (i - j) % 3 else 0.0) + rng.random()) for j in range(i + 1, min(36, i + 5))]
    schema = "id long, n int, x array<double>, offset array<double>, logits array<double>, batch int"
    return (
        spark.createDataFrame(nodes, schema),
        spark.createDataFrame(edges, "s long, t long, logit double"),
        spark.createDataFrame(overlaps, "cluster long, obj long, cnt long, y int"),
    )


def labels_of(df):
    return {(r.setting_id, r.id): r.label for r in df.collect()}


def test_grid_is_the_product_of_lists():
    assert panoptic.grid(a=[1, 2], b=5, c=["x", "y"])[2] == {"setting_id": 2, "a": 2, "b": 5, "c": "x"} and len(panoptic.grid(a=[1, 2], b=[1, 2])) == 4


def test_affinity_settings_run_side_by_side(spark, scene):
    nodes, edges, _ = scene
    settings = panoptic.grid(threshold=[0.3, 0.9, 0.99])
    got = labels_of(panoptic.by_affinity(nodes, edges, settings))
    for s in settings:
        alone = partition.components(nodes, edges.where(1 / (1 + F.exp(-F.col("logit"))) > s["threshold"]))
        assert {r.id: r.label for r in alone.collect()} == {i: v for (k, i), v in got.items() if k == s["setting_id"]}


def test_energy_settings_run_side_by_side(spark, scene):
    nodes, edges, _ = scene
    settings = panoptic.grid(regularization=[0.01, 1.0], p_weight=4.0, temperature=2.0, dampening=0.1, discrepancy_epsilon=0.5)
    got = labels_of(panoptic.by_energy(nodes, edges, settings, min_size=3))
    one = labels_of(panoptic.by_energy(nodes, edges, settings[:1], min_size=3))
    assert one == {k: v for k, v in got.items() if k[0] == 0}
    # a stronger regularization joins more
    assert len(set(one.values())) > len({v for k, v in got.items() if k[0] == 1}) >= 1


def test_stuff_is_one_instance_of_each_class_and_batch(spark, scene):
    nodes, edges, _ = scene
    labels = panoptic.by_affinity(nodes, edges, panoptic.grid(threshold=[1.0]))  # each node alone
    rows = panoptic.classified(labels, nodes, stuff=[0]).join(nodes.select("id", "batch"), "id").collect()
    stuff = [r for r in rows if r.y == 0]
    assert {r.label for r in stuff} == {min(r.id for r in stuff if r.batch == b) for b in (0, 1)}
    assert all(r.label == r.id for r in rows if r.y != 0)


def test_scores_are_those_of_each_setting_alone(spark, scene):
    nodes, edges, overlaps = scene
    settings = panoptic.grid(threshold=[0.3, 0.9])
    table = panoptic.sweep(nodes, edges, overlaps, settings, 3, [0], "affinity")
    for r in table.collect():
        labels = panoptic.by_affinity(nodes, edges, [settings[r.setting_id]])
        one = panoptic.classified(labels, nodes, [0])
        merged = instances.merge_overlaps(overlaps, one.select(F.col("id").alias("cluster"), F.col("label").alias("super_index")))
        merged = merged.join(one.select(F.col("label").alias("cluster"), F.col("y").alias("pred_y")).distinct(), "cluster")
        each = metrics.panoptic_quality(merged, 3, [0]).collect()
        assert abs(r.pq - sum(x.pq for x in each) / len(each)) < 1e-9 and r.threshold == settings[r.setting_id]["threshold"]
    best = partition.sweep(table, "pq").first()
    assert best.pq == max(r.pq for r in table.collect())


def test_offsets_move_things_only(spark, scene):
    nodes, _, _ = scene
    moved = {r.id: r.x for r in panoptic.shifted(nodes, [0]).collect()}
    for r in nodes.collect():
        stuff = r.logits.index(max(r.logits)) == 0
        assert moved[r.id] == (r.x if stuff else [a + b for a, b in zip(r.x, r.offset)])


def test_affinity_head_is_symmetric(spark, scene):
    nodes, edges, _ = scene
    w = [0.5, -1.0, 0.25, 2.0]
    one = {(r.s, r.t): r.logit for r in panoptic.affinity_logits(edges.select("s", "t"), nodes, w, 0.1).collect()}
    back = {(r.t, r.s): r.logit for r in panoptic.affinity_logits(edges.select(F.col("t").alias("s"), F.col("s").alias("t")), nodes, w, 0.1).collect()}
    assert all(abs(one[k] - back[k]) < 1e-12 for k in one)
