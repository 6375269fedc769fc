"""Splits of segments by minimum cuts: a primal-dual iteration for total variation, rounded to a cut.

With two values to choose from, the best sides of a segment's nodes are a minimum cut. Its relaxation to sides between 0 and 1
is exact, and is solved by steps on nodes and edges in turn; any threshold then gives a cut, of which the best is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of a relaxation at most, thresholds that are tried, and alternations of values and cuts.
STEPS, THRESHOLDS, ROUNDS = 400, 16, 10


def cut_energy(side: np.ndarray, u: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> float:
    return float(u[side].sum() + w[side[s] != side[t]].sum())


def relaxed_cut(u: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sides (booleans) that make the sum of u over true nodes plus w over edges (s, t) between sides as low as it finds.

    Steps are scaled by node and edge, so that they converge whatever the degrees and weights.
    """
    n = len(u)
    scale = max(float(np.abs(u).max(initial=0)), float(w.max(initial=0)), 1e-300)
    u, w = u / scale, w / scale
    tau = 1 / np.maximum(np.bincount(s, minlength=n) + np.bincount(t, minlength=n), 1)
    b = (u < 0).astype(float)
    bar, p = b, np.zeros(len(w))
    for _ in range(STEPS):
        p = np.clip(p + 0.5 * (bar[s] - bar[t]), -w, w)
        pull = np.bincount(s, p, n) - np.bincount(t, p, n)
        new = np.clip(b - tau * (u + pull), 0, 1)
        bar, moved, b = 2 * new - b, np.abs(new - b).max(initial=0), new
        if moved < 1e-7:
            break
    levels = np.unique(b)[:-1]
    levels = levels[np.linspace(0, len(levels) - 1, min(len(levels), THRESHOLDS)).astype(int)] if len(levels) else levels
    tried = [b > 0.5, u < 0, np.zeros(n, bool), np.ones(n, bool), *[b > v for v in levels]]
    return min(tried, key=lambda side: cut_energy(side, u, s, t, w))


def best_split(x: np.ndarray, n: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, side): the split of nodes of size n and features x that lowers the energy most, of those found from each dimension.

    A split begins at the mean of a dimension. Its sides' means and its sides are then made anew in turn, once by the minimum
    cut for these means and once node by node, for as long as that lowers the energy.
    """

    def gain(side: np.ndarray) -> tuple[float, np.ndarray | None]:
        a, b = n[~side].sum(), n[side].sum()
        if not a or not b:
            return -np.inf, None
        means = np.stack([(n[~side, None] * x[~side]).sum(0) / a, (n[side, None] * x[side]).sum(0) / b])
        return float(a * b / (a + b) * ((means[0] - means[1]) ** 2).sum() - w[side[s] != side[t]].sum()), means

    def by_cut(side: np.ndarray, u: np.ndarray) -> np.ndarray:
        return relaxed_cut(u, s, t, w)

    def by_node(side: np.ndarray, u: np.ndarray) -> np.ndarray:
        across = np.where(side[t], w, 0.0), np.where(side[s], w, 0.0)
        ones = np.bincount(s, across[0], len(u)) + np.bincount(t, across[1], len(u))
        both = np.bincount(s, w, len(u)) + np.bincount(t, w, len(u))
        return u + both - 2 * ones < 0

    best = (0.0, np.zeros(len(x), bool))
    for k in range(x.shape[1]):
        start = x[:, k] > (n * x[:, k]).sum() / n.sum()
        for step in (by_node, by_cut):
            side, (g, means) = start, gain(start)
            for _ in range(ROUNDS if step is by_cut else 1000):
                if means is None:
                    break
                if g > best[0]:
                    best = (g, side)
                u = n * (((x - means[1]) ** 2).sum(1) - ((x - means[0]) ** 2).sum(1))
                new = step(side, u)
                new_g, new_means = gain(new)
                if new_g <= g + 1e-12 * max(1.0, abs(g)):
                    break
                side, g, means = new, new_g, new_means
    return best


def connected(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The component of each of n nodes, by its first node."""
    part = np.arange(n)
    while True:
        low, new = np.minimum(part[s], part[t]), part.copy()
        np.minimum.at(new, part[s], low)
        np.minimum.at(new, part[t], low)
        while (new != (up := new[new])).any():
            new = up
        if (new == part).all():
            return part
        part = new


def parts(x: np.ndarray, n: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """The nodes of each part of a segment that is split, and whose parts are, for as long as that lowers the energy.

    What doesn't split and isn't connected comes apart, and is tried again. Where the edges have weights, splitting a connected
    part cuts the least of them or more, and lowers the fidelity to 0 at best: where that gains nothing, no split is looked for.
    """
    todo, done = [(np.arange(len(n)), s, t, w)], []
    while todo:
        own, s, t, w = todo.pop()
        of = connected(len(own), s, t)
        sizes, xs = n[own], x[own]
        whole = not of.any()
        off = (sizes[:, None] * (xs - (sizes[:, None] * xs).sum(0) / sizes.sum()) ** 2).sum()
        if len(own) == 1 or whole and 0 < w.min() and off <= w.min():
            done.append(own)
            continue
        gain, side = best_split(xs, sizes, s, t, w)
        if gain > 1e-9:
            of = side.astype(int)
        elif whole:
            done.append(own)
            continue
        # the nodes and inner edges of each part, in one pass over all of them
        place, order = np.zeros(len(own), int), np.argsort(of, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
        size = np.diff(np.r_[first, len(order)])
        place[order] = np.arange(len(order)) - np.repeat(first, size)
        inner = np.flatnonzero(of[s] == of[t])
        inner = inner[np.argsort(of[s[inner]], kind="stable")]
        ends = np.searchsorted(of[s[inner]], np.r_[of[order[first]], np.iinfo(int).max])
        for k, (a, m) in enumerate(zip(first, size)):
            e = inner[ends[k] : ends[k + 1]]
            todo.append((own[order[a : a + m]], place[s[e]], place[t[e]], w[e]))
    return done


#: Nodes that a task takes at once, of segments that are held whole.
HELD = 2_000


def settled(nodes: DataFrame, edges: DataFrame, reg: float) -> DataFrame:
    """(id, label): the nodes of segments c of nodes (c, id, n, x), by the largest id of the part that is left of `parts`.

    A task holds some segments with their edges (c, s, t, w), so the caller bounds the size of one.
    """

    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
        ids = [plain(v) for v in own.column("id").to_pylist()]
        at, number = {v: i for i, v in enumerate(ids)}, {}
        c = np.array([number.setdefault(plain(v), len(number)) for v in own.column("c").to_pylist()], int)
        s, t = (np.array([at[plain(v)] for v in links.column(k).to_pylist()], int) for k in ("s", "t"))
        x, n = np.array(own.column("x").to_pylist(), float).reshape(own.num_rows, -1), own.column("n").to_numpy()
        order, by_c = np.argsort(c, kind="stable"), np.argsort(c[s], kind="stable")
        first, link = (np.searchsorted(v, np.arange(len(number) + 1)) for v in (c[order], c[s][by_c]))
        place, label = np.zeros(len(c), int), np.zeros(len(c), int)
        place[order] = np.arange(len(c)) - np.repeat(first[:-1], np.diff(first))
        w = reg * links.column("w").to_numpy()
        for k in range(len(number)):
            who, e = order[first[k] : first[k + 1]], by_c[link[k] : link[k + 1]]
            for part in parts(x[who], n[who], place[s[e]], place[t[e]], w[e]):
                part = who[part]
                label[part] = max(part.tolist(), key=lambda i: ids[i])
        return pa.Table.from_arrays([own.column("id"), own.column("id").take(pa.array(label))], ["id", "label"])

    kind = dict(nodes.dtypes)["id"]
    buckets = max(1, -(-nodes.count() // HELD))
    dealt = lambda df: df.withColumn("_b", F.pmod(F.xxhash64("c"), F.lit(buckets)))
    of = dealt(nodes.select("c", "id", "n", "x")).groupBy("_b").cogroup(dealt(edges.select("c", "s", "t", "w")).groupBy("_b"))
    return of.applyInArrow(run, f"id {kind}, label {kind}")
