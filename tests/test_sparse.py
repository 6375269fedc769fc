"""Sparse convolutions against loops over cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import sparse


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(6)
    spots = sorted({(g, rng.randrange(-3, 4), rng.randrange(-3, 4), rng.randrange(-3, 4)) for g in (0, 1) for _ in range(60)})
    rows = [(i, *s, [rng.random(), rng.random()]) for i, s in enumerate(spots)]
    return spark.createDataFrame(rows, "id long, g int, cx int, cy int, cz int, x array<double>"), rows


def by_hand(rows, size, stride, dilation, weight, bias):
    """{(g, cell): output} of a convolution."""
    at = {(g, (a, b, c)): np.array(x) for _, g, a, b, c, x in rows}
    outs = {(g, tuple(v // stride for v in spot)) for g, spot in at}
    made = {}
    for g, spot in outs:
        total, seen = np.array(bias, float), False
        for k, o in enumerate(sparse.offsets(size, dilation)):
            x = at.get((g, tuple(stride * v + d for v, d in zip(spot, o))))
            if x is not None:
                total, seen = total + np.array(weight[k]) @ x, True
        if seen:
            made[g, spot] = total
    return made


@pytest.mark.parametrize("size,stride,dilation", [(3, 1, 1), (3, 1, 2), (2, 2, 1), (3, 2, 1), (5, 1, 1)])
def test_convolution(spark, cells, size, stride, dilation):
    df, rows = cells
    rng = random.Random(size)
    weight, bias = [[[rng.random() for _ in range(2)] for _ in range(3)] for _ in range(size**3)], [0.1, 0.2, 0.3]
    rules = sparse.rulebook(df, size, stride, dilation, ["g"])
    out = sparse.convolve(df.select("id", "x"), rules, weight, bias).join(rules.cells, "id").collect()
    got = {(r.g, (r.cx, r.cy, r.cz)): r.x for r in out}
    want = by_hand(rows, size, stride, dilation, weight, bias)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_blocks_share_a_rulebook_and_add_their_input(spark, cells, monkeypatch):
    df, rows = cells
    made = []
    monkeypatch.setattr(sparse, "rulebook", lambda *a, f=sparse.rulebook, **b: made.append(a[1:]) or f(*a, **b))
    weight = [[[0.1 * (k % 3), -0.2], [0.05, 0.1]] for k in range(27)]
    layer = sparse.ConvBlock(weight, norm=([1.0, 2.0], [0.5, 0.0]), residual=True)
    out, _ = sparse.cnn(df, [layer, layer], by="g", residual=True)
    assert made == [(3, 1, 1)]
    x = {(g, (a, b, c)): np.array(v) for _, g, a, b, c, v in rows}
    now = dict(x)
    for _ in range(2):
        y = by_hand([(0, g, *s, v) for (g, s), v in now.items()], 3, 1, 1, weight, [0, 0])
        for g in (0, 1):
            own = np.stack([v for k, v in y.items() if k[0] == g])
            for k in [k for k in y if k[0] == g]:
                y[k] = (y[k] - own.mean(0)) / np.sqrt(own.var(0) + 1e-5) * [1.0, 2.0] + [0.5, 0.0]
        now = {k: np.maximum(y[k] + now[k], 0) for k in y}
    got = {(r.g, (r.cx, r.cy, r.cz)): r.x for r in df.select("id", "g", "cx", "cy", "cz").join(out, "id").collect()}
    assert all(np.allclose(got[k], now[k] + x[k]) for k in x)
    assert df.where(F.lit(False)).count() == 0 and sparse.rulebook(df.where("id < 0")).rows.count() == 0
