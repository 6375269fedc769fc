"""Operators that SQL can't express, and edge cases, against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import features
from lattica.operators import columns, graph, hierarchy, ids, metrics, neighbors, partition, ragged, sampling, voxels
from lattica.plans import pipeline

from .conftest import DATA, same_rows


def cloud(spark, n=120, seed=0, extent=10.0):
    rng = random.Random(seed)
    rows = [(i, *[rng.uniform(0, extent) for _ in "xyz"]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pid long, x double, y double, z double")


def test_recursive_inliers(spark):
    rows, df = cloud(spark)
    at, left = {r[0]: r[1:] for r in rows}, set(range(len(rows)))
    while True:
        keep = {i for i in left if sum(j != i and math.dist(at[i], at[j]) <= 2.0 for j in left) >= 3}
        if keep == left:
            break
        left = keep
    assert {r.pid for r in neighbors.inliers(df, 3, 2.0, recursive=True).collect()} == left


def test_recursive_inliers_of_an_open_line(spark):
    rows = [(i, float(i), 0.0, 0.0) for i in range(300)] + [(1000 + i, 0.1 * i, 500.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double").coalesce(1)
    assert {r.pid for r in neighbors.inliers(df, 2, 1.5, recursive=True).collect()} == {1000, 1001, 1002}


def test_recursive_inliers_look_for_pairs_once(spark, monkeypatch):
    """A line that is long leaves in a few rounds; points of one place, on the edges of cells and below zero."""
    rows = [(i, float(i % 40), float(i // 40 % 2), 0.0) for i in range(80)] + [(100 + i, float(i), 500.0, 0.0) for i in range(900)]
    rows += [(2000 + i, -1.5, -3.0, 0.0) for i in range(3)] + [(3000, -3.0, -3.0, 0.0), (3001, -1.5, -4.5, 0.0), (4000, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    put, tables = neighbors.written, []
    monkeypatch.setattr(neighbors, "written", lambda t: tables.append(1) or put(t))
    got = {r.pid for r in neighbors.inliers(df, 2, 1.5, recursive=True).collect()}
    assert got == {*range(80), 2000, 2001, 2002, 3000, 3001} and len(tables) <= 21
    pairs = sorted((r.i, r.j, r.d) for r in neighbors.pairs_within(df, 1.5).collect())
    assert pairs == sorted((r.i, r.j, r.d) for r in neighbors.within_radius(df, df, 1.5).where("i <> j").collect())


def test_knn_is_exact(spark):
    rows, df = cloud(spark, 80, 1)
    got = {(r.i, r.rank): r.j for r in neighbors.knn(df, 3, 50.0).collect()}
    for i, *p in rows:
        best = sorted((math.dist(p, q), j) for j, *q in rows if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]


def test_knn_in_blocks_is_the_same(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<float>")
    one, many = (sorted(map(tuple, neighbors.knn_vectors(df, df, 3, block).collect())) for block in (1000, 7))
    assert one == many and len(one) == 180


def test_knn_of_odd_vectors_is_that_of_sql(spark, duck):
    """Copies, near copies, very long and short vectors, and vectors with nulls or without a value; all are queries."""
    rng = np.random.default_rng(5)
    x = [rng.normal(size=6).astype(np.float32) * scale for scale in (1, 1e-30, 1e3, 3e18) for _ in range(60)]
    x += [x[0]] * 40 + [np.nextafter(x[k], np.float32(9)) for k in (0, 0, 1, 70, 130)] + [np.zeros(6, np.float32)] * 9
    rows = [[float(v) for v in r] for r in x] + [None, [], [None] * 6, [1.0, 2.0], [0.5, None, 1.0, 0.0, 0.0, 0.0], [1.0] * 9]
    rows = [(int(i), r) for i, r in zip(rng.permutation(len(rows)), rows)] + [(None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duck(DATA)
    embeddings = df.toArrow()
    con.register("embeddings", embeddings)
    wanted = con.sql(
        """SELECT i, CAST(rank AS INTEGER) AS rank, j, d FROM (SELECT a.vec_id AS i, b.vec_id AS j,
        sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda e: (e[1]::DOUBLE - e[2]::DOUBLE) * (e[1]::DOUBLE - e[2]::DOUBLE)))) AS d,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY d NULLS LAST, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5"""
    )
    for block in (1000, 50):
        same_rows(neighbors.knn_vectors(df, df, 5, block).select("i", "rank", "j", "d"), wanted, 0)


def test_knn_of_one_task_takes_rows_as_they_come():
    """More rows and queries than one product takes, against all distances."""
    from lattica.operators import vectors

    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 8)).astype(np.float32)
    rows = pa.table({"j": np.arange(20_000), "s": list(x)})
    got = vectors.search(pa.table({"i": np.arange(1500) * 7, "q": list(x[: 1500 * 7 : 7])}), rows.to_batches(9000), 4).to_pydict()
    for i in range(0, 1500 * 7, 700):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        near = [j for j in np.lexsort((np.arange(20_000), d)) if j != i][:4]
        assert [j for a, j in zip(got["i"], got["j"]) if a == i] == near


def test_ranked_spreads_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.9 else rng.randrange(1, 5), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, id long")
    got = {r.id: (r.rank, r.sum_v) for r in ids.ranked(df, ["k"], [F.desc("v"), "id"], sums=("v",)).collect()}
    for k in range(5):
        total = 0
        for n, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            total += v
            assert got[i] == (n, total)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0, 3.0, 1.0], [None, 2.0, 9.0, 4.0, 7.0]])
def test_lower_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own = sorted(v for v in values if v is not None)
    assert ids.lower_median(df, "v").first().median == own[(len(own) - 1) // 2]


def test_lower_median_of_nothing(spark):
    assert ids.lower_median(spark.createDataFrame([], "v double"), "v").count() == 0


def _graph(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, 1, [float(i // 10) + rng.gauss(0, 0.05), rng.gauss(0, 0.05)]) for i in range(40)]
    edges = [(i, j, 1.0) for i in range(40) for j in range(i + 1, 40) if abs(i - j) <= 2]
    return spark.createDataFrame(nodes, "id long, n int, x array<double>"), spark.createDataFrame(edges, "s long, t long, w double")


@pytest.mark.parametrize("how", ["greedy", "cut"])
def test_partitions_find_the_steps(spark, how):
    nodes, edges = _graph(spark, 4)
    if how == "greedy":
        labels = partition.greedy_merge(nodes, edges, 0.1)
    else:
        labels = partition.cut_pursuit(nodes.withColumn("tile", F.lit(0)), edges, 0.1).drop("tile")
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.id // 10)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    energy = partition.partition_energy(nodes, edges, labels, 0.1).first().energy
    alone = partition.partition_energy(nodes, edges, nodes.select("id", F.col("id").alias("label")), 0.1).first().energy
    assert energy < alone


def test_cut_pursuit_goes_across_tiles_and_as_deep_as_it_must(spark):
    # a flat stretch over three tiles, and a stair of more steps than twelve splits in a row make
    flat = [(i, 1, [500.0], i // 20) for i in range(60)]
    stair = [(1000 + i, 1, [100.0 ** (i // 2)], 9) for i in range(28)]
    edges = [(i, i + 1, 1.0) for i in range(59)] + [(1000 + i, 1001 + i, 1.0) for i in range(27)]
    nodes = spark.createDataFrame(flat + stair, "id long, n int, x array<double>, tile int")
    label = {r.id: r.label for r in partition.cut_pursuit(nodes, spark.createDataFrame(edges, "s long, t long, w double"), 0.01).collect()}
    assert len({label[i] for i in range(60)}) == 1
    assert len({label[1000 + i] for i in range(28)}) == 14 and all(label[1000 + i] == label[1001 + i] for i in range(0, 28, 2))


def test_small_segments_are_merged(spark):
    nodes, edges = _graph(spark, 5)
    sizes = partition.greedy_merge(nodes, edges, 1e-9, min_size=5).groupBy("label").count().collect()
    assert min(r["count"] for r in sizes) >= 5


def test_merges_go_on_until_none_is_left(spark):
    # a flat chain with rising ids, a hub of equal points, and a hub whose neighbours are only too small
    chain = [(i, 1, [0.0]) for i in range(150)]
    equal = [(1000 + i, 1, [50.0]) for i in range(120)]
    small = [(2000, 10, [900.0])] + [(2000 + i, 1, [900.0 + i]) for i in range(1, 120)]
    edges = [(i, i + 1, 1.0) for i in range(149)] + [(1000, 1000 + i, 1.0) for i in range(1, 120)] + [(2000, 2000 + i, 1.0) for i in range(1, 120)]
    nodes = spark.createDataFrame(chain + equal + small, "id long, n int, x array<double>")
    labels = partition.greedy_merge(nodes, spark.createDataFrame(edges, "s long, t long, w double"), 0.1, min_size=2)
    assert {r.id: r.label for r in labels.collect()} == {r[0]: r[0] // 1000 * 1000 for r in chain + equal + small}


def test_no_merge_lowers_the_energy_after_the_last(spark):
    rng = random.Random(12)
    rows = [(i, 1 + i % 3, [rng.choice([0.0, 1.0, 1.2]), rng.gauss(0, 0.3)]) for i in range(90)]
    links = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(200)) if a != b}
    nodes, edges = spark.createDataFrame(rows, "id long, n int, x array<double>"), spark.createDataFrame([(*p, 1.0) for p in sorted(links)], "s long, t long, w double")
    label = {r.id: r.label for r in partition.greedy_merge(nodes, edges, 0.2, min_size=4).collect()}
    groups = {}
    for i, n, x in rows:
        groups.setdefault(label[i], []).append((n, np.array(x)))
    size = {g: sum(n for n, _ in own) for g, own in groups.items()}
    mean = {g: sum(n * x for n, x in own) / size[g] for g, own in groups.items()}
    cut = {}
    for s, t in links:
        if label[s] != label[t]:
            pair = tuple(sorted((label[s], label[t])))
            cut[pair] = cut.get(pair, 0) + 1
    for (a, b), w in cut.items():
        assert min(size[a], size[b]) >= 4
        assert 0.2 * w - size[a] * size[b] / (size[a] + size[b]) * ((mean[a] - mean[b]) ** 2).sum() <= 1e-9


def test_eigen_features_of_a_line_and_a_plane(spark):
    rng = random.Random(6)
    rows = [(0, rng.random() * 10, 0.0, 0.0) for _ in range(50)] + [(1, rng.random() * 10, rng.random() * 10, 0.0) for _ in range(200)] + [(2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pid long, g int, x double, y double, z double")
    got = {r.g: r for r in features.segment_features(df, "g").collect()}
    assert got[0].linearity > 0.99 and got[1].planarity > 0.8 and abs(got[1].nz) > 0.999
    assert got[2].linearity == 0 and got[2].log_size == pytest.approx(0)


def test_ransac_plane(spark):
    rng = random.Random(7)
    rows = [(i, x := rng.random() * 10, y := rng.random() * 10, 0.5 * x - 0.25 * y + 1 + (50 * rng.random() if i % 5 == 0 else 0)) for i in range(200)]
    p = features.robust_ground_plane(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 0.01).first()
    assert (p.a, p.b, p.c) == pytest.approx((0.5, -0.25, 1), abs=1e-6)


def test_base_vectors_are_orthonormal(spark):
    vectors = [(0.0, 0.0, 0.0), (0.0, 0.0, -2.0), (1.0, 2.0, 3.0), (-1.0, 0.0, 0.0)]
    df = spark.createDataFrame(vectors, "x double, y double, z double")
    for r in df.select(*features.base_vectors(*[F.col(d) for d in "xyz"])).collect():
        m = np.array(list(r)).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9)


def test_border_pairs_match_facing_points(spark):
    rows = [(i, 0, -0.1 * (i // 5), float(i % 5), 0.0) for i in range(25)] + [(100 + i, 1, 1 + 0.1 * (i // 5), float(i % 5), 0.0) for i in range(25)]
    df = spark.createDataFrame(rows, "pid long, super_index int, x double, y double, z double")
    pairs = graph.border_pairs(df, spark.createDataFrame([(0, 1)], "s int, t int"), "super_index", 0.2, 5).collect()
    assert len(pairs) == 5 and all(p.j - p.i == 100 and p.i < 5 for p in pairs)


def test_average_precision_of_a_perfect_prediction(spark):
    rows = [(i, i, 10, i % 2, i % 2, 0.5 + i / 100) for i in range(10)]
    ap = metrics.average_precision(spark.createDataFrame(rows, "cluster long, obj long, cnt long, y int, pred_y int, score double"), 2)
    assert metrics.summarize_ap(ap).first().map == pytest.approx(1)


def test_panoptic_quality_of_an_empty_table(spark):
    df = spark.createDataFrame([], "cluster long, obj long, cnt long, y int, pred_y int, score double")
    assert metrics.panoptic_quality(df, 3).count() == 0


def test_hierarchy_round_trip(spark, tmp_path):
    _, df = cloud(spark, 60, 8)
    h = hierarchy.grid_hierarchy(df, [2.0, 5.0])
    h.save(f"{tmp_path}/h")
    back = hierarchy.Hierarchy.load(spark, f"{tmp_path}/h", [1], ["id", "x"], kinds=("nodes",))
    assert columns.tables_equal(back.nodes[1], h.nodes[1].select("id", "x"))


def test_level_selectors():
    assert hierarchy.levels_of("1+", 3) == [1, 2] and hierarchy.levels_of("1-", 3) == [0]
    assert hierarchy.levels_of("all", 2, 1) == [1, 2] and hierarchy.levels_of(2, 3) == [2]


def test_strict_keys(spark):
    _, df = cloud(spark, 5)
    with pytest.raises(KeyError):
        columns.add_keys(df, ["nope"])
    assert columns.remove_keys(df, ["nope"]).columns == df.columns


def test_samples_repeat_and_differ_by_seed(spark):
    _, df = cloud(spark, 200, 9)
    df = df.withColumn("g", F.lit(0))
    a, b, c = ({r.pid for r in sampling.sparse_sample(df, "g", 32, 1, seed=s).collect()} for s in (1, 1, 2))
    assert a == b != c and len(a) == math.floor(32 * math.tanh(200 / 32))


def test_pipeline_is_cached(spark, tmp_path):
    _, df = cloud(spark, 50, 10)
    spec = [{"transform": "grid_sampling", "params": {"size": [2.0, 2.0, 2.0]}}]
    one = pipeline.cached(spark, df, spec, str(tmp_path))
    # the second call reads what the first has written
    assert columns.tables_equal(one, pipeline.cached(spark, df.limit(0), spec, str(tmp_path)))
    assert pipeline.spec_hash(spec) == pipeline.spec_hash([spec])


def test_empty_voxels(spark):
    df = spark.createDataFrame([], "pid long, x double, y double, z double")
    assert voxels.grid_sampling(df, (1.0, 1.0, 1.0)).count() == 0
    assert voxels.xy_partition(df, 1.0).count() == 0
    assert ragged.to_lists(df, "pid", "x", ["y"]).count() == 0


def test_tile_of_a_box_without_extent(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 0.0)], "pid long, x double, y double, z double")
    assert sampling.xy_tile(df, 0, 0, 2).count() == 0


def test_jitter_is_clipped(spark):
    _, df = cloud(spark, 100, 11)
    out = columns.jitter(df, ["x"], 1.0, 0.05).withColumnRenamed("x", "nx").join(df, "pid")
    assert out.agg(F.max(F.abs(F.col("nx") - F.col("x")))).first()[0] <= 0.05 + 1e-9


def test_panoptic_quality_by_fold(spark):
    rng = random.Random(11)
    rows = [(0, c, o, rng.randrange(1, 30), o % 3, c % 3) for c in range(12) for o in range(12) if rng.random() < 0.2 or c == o]
    both = [*rows, *[(1, c + 100, o + 100, n, y, p) for _, c, o, n, y, p in rows]]
    kind = "fold int, cluster long, obj long, cnt long, y int, pred_y int"
    one = metrics.panoptic_quality(spark.createDataFrame(rows, kind).drop("fold"), 3, [0]).collect()
    two = metrics.panoptic_quality(spark.createDataFrame(both, kind), 3, [0], ["fold"]).collect()
    assert len(one) == 3 and {tuple(r[1:]) for r in two} == set(map(tuple, one)) and len(two) == 6


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    ids = sorted({x for e in edges for x in e} | {9999})
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.label for r in partition.components(nodes, spark.createDataFrame(edges, "s long, t long")).collect()}
    assert got == {i: 200 if i <= 200 else 1299 if 1000 <= i < 1300 else i for i in ids}


def test_collections():
    from lattica.sources import catalog

    assert catalog.s3dis(5).cloud_ids("test") == ["Area_5"] and len(catalog.s3dis(5).cloud_ids("train")) == 5
    assert catalog.s3dis(1, ("Area_1/a", "Area_2/a"), (0, 1, 2)).cloud_ids("test") == ["Area_1/a"]
    assert catalog.KITTI360.things == [2, 11] and len(catalog.DALES.cloud_ids("trainval")) == 29
    with pytest.raises(ValueError):
        catalog.Collection("x", 1, (), {"train": ("a",), "val": ("a",)})


def test_forward_pass_without_edges_or_children(spark):
    from lattica.operators import network

    one = ([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    block = network.Block(one, one, one, ([[1.0, 0.0], [0.0, 1.0]], [0.5, -0.5]), [([[0.0, 0.0]], [0.0]), ([[0.0], [0.0]], [0.0, 0.0])])
    nodes = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 5.0])], "id long, graph int, x array<double>")
    links = spark.createDataFrame([(1, 2)], "s long, t long")
    alone = {r.id: r.x for r in network.transformer_block(nodes, links, block).collect()}
    assert alone[2] == [3.5, 4.5]  # no edges: the bias only
    mean, var = 2.75, 2.1875
    assert alone[1] == pytest.approx([1.5 + (3 - mean) / math.sqrt(var + 1e-5), 1.5 + (5 - mean) / math.sqrt(var + 1e-5)])
    assert {r.id: r.x for r in network.transformer_block(nodes, None, block).collect()} == {1: [1.0, 2.0], 2: [3.0, 5.0]}
    assert network.transformer_block(nodes.limit(0), links, block).count() == 0
    children = spark.createDataFrame([(7, 1, [4.0]), (8, 1, [-1.0])], "id long, super_index long, x array<double>")
    assert {r.id: r.x for r in network.down_stage(nodes, children, None, network.Stage()).collect()} == {1: [1.0, 2.0, 4.0], 2: [3.0, 5.0]}


def test_noise_is_that_of_its_counter(spark):
    """Against MD5 by hand, the same under any partitioning, and normal."""
    import hashlib

    from lattica.functions import noise

    df = spark.range(4000)
    make = lambda rows: {r.id: (r.u, r.n) for r in rows.select("id", noise.uniform(9, "id").alias("u"), noise.normal(9, "id", F.lit("x")).alias("n")).collect()}
    one, other = make(df), make(df.repartition(7, F.rand(1)))
    assert one == other
    at = lambda text: (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    assert all(abs(one[i][0] - at(f"9:{i}")) < 1e-15 for i in range(50))
    want = [math.sqrt(-2 * math.log(at(f"9:r:{i}:x"))) * math.cos(2 * math.pi * at(f"9:a:{i}:x")) for i in range(50)]
    assert all(abs(one[i][1] - want[i]) < 1e-9 for i in range(50))
    n = np.array([v[1] for v in one.values()])
    assert abs(n.mean()) < 0.06 and abs(n.std() - 1) < 0.05 and abs(np.mean(np.abs(n) < 1) - 0.6827) < 0.03


def test_noise_by_level(spark):
    low, high = (spark.createDataFrame([(i, 0.0, 0.0) for i in range(20)], "id long, x double, z double") for _ in range(2))
    a, b = columns.jitter_levels([low, high.drop("x")], ["x", "z"], [0.0, 1.0], [0.05, 0.5])
    assert a.agg(F.sum(F.abs("x") + F.abs("z"))).first()[0] == 0 and b.columns == ["id", "z"]
    top = b.agg(F.max(F.abs("z")).alias("m"), F.count_distinct("z").alias("n")).first()
    assert top.m == 0.5 and top.n > 5


def test_lower_median_of_equal_values_and_of_groups(spark):
    df = spark.createDataFrame([(1, 5)] * 50 + [(2, v) for v in (4, 1, 3, 2)] + [(3, None), (None, 7), (None, 8)], "k int, v int")
    assert {r.k: r.median for r in ids.lower_median(df, "v", ["k"]).collect()} == {1: 5, 2: 2, None: 7}
    assert ids.lower_median(df.where("k = 2"), "v").first().median == 2
    assert ids.lower_median(df.where("k = 3"), "v").count() == 0


def test_eigen_columns_are_those_of_a_solver(spark):
    """Random, flat, straight, round and empty covariances, and some with equal eigenvalues."""
    from lattica.functions import eigen

    rng = np.random.default_rng(4)
    turn = [np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(40)]
    values = [rng.random(3) * 10 ** rng.integers(-2, 3) for _ in range(24)]
    values += [(1, 1, 0.5), (2, 0.5, 0.5), (3, 0, 0), (3, 2, 0), (1, 1, 1), (0, 0, 0), (5, 5, 0), (1, 1 - 1e-7, 0.2), (1, 0.2, 0.2 + 1e-7)]
    m = [q @ np.diag(v) @ q.T for q, v in zip(turn, values)] + [np.diag(v).astype(float) for v in [(1, 2, 3), (3, 2, 1), (2, 2, 5), (0, 0, 4)]]
    rows = [(i, 9, *[float(a[j, k]) for j, k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]) for i, a in enumerate(m)]
    df = spark.createDataFrame(rows, "i int, n int, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")
    out = df
    for level in eigen.levels(eigen.steps()):
        out = out.withColumns({k: F.expr(v) for k, v in level.items()})
    for r in out.collect():
        a, scale = m[r.i], max(1e-12, np.abs(m[r.i]).max())
        l = np.array([r._l1, r._l2, r._l3])
        v = np.array([[r[f"_v{k}{d}"] for d in "xyz"] for k in (1, 2, 3)])
        want = np.sqrt(np.maximum(np.linalg.eigvalsh(a)[::-1], 0))
        assert np.abs(l - want).max() <= 2e-5 * np.sqrt(scale), (r.i, l, want)
        assert np.abs(v @ v.T - np.eye(3)).max() < 1e-9 and np.abs(v.T @ np.diag(l * l) @ v - a).max() < 1e-7 * scale, r.i
    made = features.eigen_features(df, 5).collect()
    assert all(r.nz >= -1e-9 for r in made) and set(made[0].asDict()) >= {"linearity", "verticality", "nz", "i", "n"}
    few = features.eigen_features(df.withColumn("n", F.lit(4)), 5).agg(F.sum(F.abs("length") + F.abs("nz"))).first()[0]
    assert few == 0
