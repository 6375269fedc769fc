"""Minimum cuts and splits against all cuts of small graphs."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import mincut, partition


def graph(rng, n, m):
    s, t = rng.integers(0, n, m), rng.integers(0, n, m)
    keep = s != t
    return s[keep], t[keep], rng.random(keep.sum())


def all_sides(n):
    return np.array(list(product([False, True], repeat=n)))


@pytest.mark.parametrize("seed", range(12))
def test_the_cut_is_the_least_of_all(seed):
    rng = np.random.default_rng(seed)
    s, t, w = graph(rng, 12, 30)
    u = rng.normal(size=12) * rng.choice([0.3, 1, 3])
    sides = all_sides(12)
    least = (sides * u).sum(1) + (w * (sides[:, s] != sides[:, t])).sum(1)
    got = mincut.cut_energy(mincut.relaxed_cut(u, s, t, w), u, s, t, w)
    assert got == pytest.approx(least.min(), abs=1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_a_split_is_worth_what_it_says(seed):
    rng = np.random.default_rng(seed)
    x, n = np.concatenate([rng.normal(size=(6, 2)), rng.normal(size=(6, 2)) + 3]), rng.integers(1, 5, 12).astype(float)
    s, t, w = graph(rng, 12, 24)
    gain, side = mincut.best_split(x, n, s, t, w)

    def fidelity(of):
        return sum((n[of, None] * (x[of] - (n[of, None] * x[of]).sum(0) / n[of].sum()) ** 2).sum() for of in (of, ~of) if of.any())

    def worth(side):
        return fidelity(np.ones(12, bool)) - fidelity(side) - w[side[s] != side[t]].sum()

    assert gain == pytest.approx(worth(side))
    best = max(worth(v) for v in all_sides(12))
    assert gain >= 0.9 * best > 0


def test_energy_is_never_above_that_of_splits_by_node(spark):
    rng = np.random.default_rng(3)
    n = 10
    x = rng.normal(size=(n, 1)) + (np.arange(n) // 5)[:, None] * 2
    s, t, w = graph(rng, n, 20)
    nodes = spark.createDataFrame([(i, float(rng.integers(1, 4)), x[i].tolist()) for i in range(n)], "id long, n double, x array<double>")
    edges = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(s, t, w)], "s long, t long, w double")
    found = [partition.cut_pursuit(nodes, edges, 0.4, exact) for exact in (1000, 0)]
    energy = [partition.partition_energy(nodes, edges, labels, 0.4).first().energy for labels in found]
    assert energy[0] <= energy[1] + 1e-9
    assert found[0].select("id").distinct().count() == n and 1 < found[0].select("label").distinct().count() < n


def test_keys_may_be_pairs(spark):
    nodes = spark.createDataFrame([((k, i), 1.0, [float(i // 3)]) for k in range(2) for i in range(6)], "id struct<k:int,i:long>, n double, x array<double>")
    edges = nodes.select(F.col("id").alias("s"), F.struct("id.k", (F.col("id.i") + 1).alias("i")).alias("t"), F.lit(0.1).alias("w")).where("t.i < 6")
    labels = {(r.id.k, r.id.i): r.label for r in partition.cut_pursuit(nodes, edges, 1.0).collect()}
    assert {(k, i): v for (k, i), v in labels.items()} == {(k, i): (k, 3 * (i // 3)) for k in range(2) for i in range(6)} or len({tuple(v) for v in labels.values()}) == 4


def test_parts_go_to_the_end_and_skip_what_cannot_gain(spark, monkeypatch):
    """Two far levels of a line, and two near ones elsewhere that are not connected; small segments are not looked at."""
    x = np.array([0.0] * 5 + [9.0] * 5 + [0.0] * 5)[:, None]
    s = np.arange(14)
    got = mincut.parts(x, np.ones(15), s, s + 1, np.full(14, 0.5))
    assert sorted(sorted(p.tolist()) for p in got) == [list(range(5)), list(range(5, 10)), list(range(10, 15))]
    apart = mincut.parts(x[:4] + np.arange(4)[:, None] * 1e-3, np.ones(4), np.array([0, 2]), np.array([1, 3]), np.full(2, 0.5))
    assert sorted(sorted(p.tolist()) for p in apart) == [[0, 1], [2, 3]]
    monkeypatch.setattr(mincut, "best_split", lambda *a: 1 / 0)
    assert [p.tolist() for p in mincut.parts(x[:5] + np.arange(5)[:, None] * 0.01, np.ones(5), s[:4], s[:4] + 1, np.full(4, 0.5))] == [list(range(5))]
    nodes = spark.createDataFrame([(c, 2 * c + k, 1.0, [k * (5.0 if c == 7 else 0.1)]) for c in range(20) for k in (0, 1)], "c long, id long, n double, x array<double>")
    inside = spark.createDataFrame([(c, 2 * c, 2 * c + 1, 1.0) for c in range(20)], "c long, s long, t long, w double")
    assert [tuple(r) for r in partition._worth(nodes, inside, 0.05, 1, True).collect()] == [(7, 2)]
