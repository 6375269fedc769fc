"""Partitions of graphs: connected components, greedy merges, and the piecewise-constant energy.

Loops write each round's table to the shared folder; what the driver sees of a round is one count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written
from . import mincut


def components(nodes: DataFrame, edges: DataFrame, rounds: int = -1) -> DataFrame:
    """(id, label): weakly connected components by the largest id; after `rounds` hops, if that is not negative.

    Without a bound, edges are turned into stars by large-star and small-star steps in turn, until each component is one
    star around its largest id. No step joins on labels, so a giant component is no hot key of a join.
    """
    if rounds < 0:
        return nodes.select("id").join(_stars(edges), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    both = written(edges.select("s", "t").union(edges.select("t", "s")).where("s <> t").distinct())
    last = labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("id", "t"), "t").groupBy(F.col("s").alias("id")).agg(F.max("label").alias("_m"))
        new = written(labels.join(around, "id", "left").select("id", "label", F.greatest("label", F.coalesce("_m", "label")).alias("now")))
        changed = new.where("now <> label").limit(1).count()
        dropped(last)
        last, labels = new, new.select("id", F.col("now").alias("label"))
        if not changed:
            break
    return labels


def _stars(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes that an edge joins to a larger one of their component."""
    now = written(edges.where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before, seen = None, mark(now)
    while seen[0] and seen != before:
        # each node's smaller neighbours are hung to its largest one, itself included
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        top = both.groupBy("a").agg(F.max("b").alias("m")).select("a", F.greatest("a", "m").alias("m"))
        large = both.join(top, "a").where("b < a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each node's larger neighbours, and itself, to the largest of these
        top = large.groupBy("a").agg(F.max("b").alias("m"))
        hung = large.join(top, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, written(hung.union(top.select("a", F.col("m").alias("b"))).distinct())
        dropped(old)
        before, seen = seen, mark(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("label"))


def edge_weights(lengths: DataFrame, mode: str = "unit", d_0: float | None = None, affinity: str | None = None) -> DataFrame:
    """`lengths` (s, t, d) with w by one of the modes unit, inverse, exp, affinity; d_0 is the mean length if not given."""
    if mode == "unit":
        return lengths.withColumn("w", F.lit(1.0))
    if mode == "affinity":
        return lengths.withColumn("w", F.col(affinity))
    scale = F.lit(d_0) if d_0 else F.col("_d0")
    if not d_0:
        lengths = lengths.crossJoin(F.broadcast(lengths.agg(F.avg("d").alias("_d0"))))
    f: dict[str, Column] = {"inverse": 1 / (1 + F.col("d") / scale), "exp": F.exp(-F.col("d") / scale)}
    return lengths.withColumn("w", f[mode]).drop("_d0")


def greedy_merge(nodes: DataFrame, edges: DataFrame, reg: float, min_size: int = 1, rounds: int = -1) -> DataFrame:
    """(id, label): nodes (id, n, x array) merged while that lowers the energy, then while they are too small.

    Energy: the sum of n |x - mean|^2 within segments, plus reg times the weight of the edges between them. Merging a and b
    costs n_a n_b / (n_a + n_b) |x_a - x_b|^2 and saves reg w_ab. Segments under min_size merge before all others, with the
    neighbour of most gain. In each round the pairs merge that are each other's best gain, ties following a hash of the
    pair; the best of all gains always is such a pair, so rounds go on until no merge is left (or `rounds`, if that is not
    negative). A segment also takes along, in the same round, those that have it as their best: if they are under min_size
    and it is not, or if their merge lowers the energy in whatever order they come. The label is the least id.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    seg = written(nodes.select("id", F.col("n").cast("double").alias("n"), F.col("x").cast("array<double>").alias("x")))
    e = written(edges.where("s <> t").groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum("w").alias("w")))
    k = 0
    while rounds < 0 or k < rounds:
        k += 1
        to = written(_merges(seg, e, reg, min_size))
        if to.isEmpty():
            break
        move = lambda df, c: df.join(to.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        moved = move(seg, "id").withColumn("wx", F.transform("x", lambda v: v * F.col("n")))
        total = moved.select("id", "n", F.posexplode("wx").alias("k", "v")).groupBy("id", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        old = [seg, labels, e, to]
        seg = written(total.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", (F.col("v") / F.col("n")).alias("v")))).alias("_x")).select("id", "n", F.transform("_x", lambda p: p["v"]).alias("x")))
        labels = written(move(labels, "label"))
        e = written(move(move(e, "s"), "t").where("s <> t").groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum("w").alias("w")))
        dropped(*old)
    return labels


def _merges(seg: DataFrame, e: DataFrame, reg: float, min_size: int) -> DataFrame:
    """(id, _to): the segments that one round of `greedy_merge` moves."""
    ends = e.join(seg.withColumnsRenamed({"id": "s", "n": "na", "x": "xa"}), "s").join(seg.withColumnsRenamed({"id": "t", "n": "nb", "x": "xb"}), "t")
    ends = ends.withColumn("sq", F.aggregate(F.zip_with("xa", "xb", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    ends = ends.withColumn("gain", reg * F.col("w") - F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * F.col("sq"))
    small = F.least("na", "nb") < min_size
    scored = ends.select("s", "t", "na", "nb", "w", F.sqrt("sq").alias("d"), F.struct(small.alias("small"), "gain", F.xxhash64("s", "t").alias("h"), "s", "t").alias("rank"))
    scored = scored.where("rank.small or rank.gain > 0")
    both = scored.union(scored.select("t", "s", "nb", "na", "w", "d", "rank"))
    pick = both.groupBy("s").agg(F.max_by(F.struct("t", "na", "nb", "w", "d"), "rank").alias("p")).select("s", "p.*")
    back = pick.select(F.col("s").alias("t"), F.col("t").alias("_back"))
    # of a pair that is each other's best, the smaller segment (of equals the larger id) goes to the other
    pick = pick.join(back, "t").withColumn("_pair", F.expr("_back = s and (na < nb or (na = nb and s > t))"))
    # merges with what has picked t move its mean by less than _far
    own = pick.groupBy("t").agg(F.max("_pair").alias("_centre"), F.sum(F.when(F.expr("na <= nb"), F.col("na") * F.col("d") / F.col("nb")).otherwise(0.0)).alias("_far"))
    certain = F.col("_centre") & F.expr("na <= nb and _back <> s") & (reg * F.col("w") > F.col("na") * (F.col("d") + F.col("_far")) * (F.col("d") + F.col("_far")))
    leaf = (F.col("na") < min_size) & (F.col("nb") >= min_size)
    members = pick.join(own, "t").where(F.col("_pair") | leaf | certain).select("s", "t")
    least = members.groupBy("t").agg(F.least("t", F.min("s")).alias("_to"))
    return members.join(least, "t").select(F.col("s").alias("id"), "_to").union(least.select(F.col("t").alias("id"), "_to")).where("id <> _to")


def partition_energy(nodes: DataFrame, edges: DataFrame, labels: DataFrame, reg: float) -> DataFrame:
    """One row: fidelity, contour, energy of a labelling of nodes (id, n, x array)."""
    rows = nodes.join(labels, "id").select("label", "n", F.posexplode("x").alias("k", "v"))
    sums = rows.groupBy("label", "k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"))
    fidelity = sums.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("fidelity"))
    cut = edges.join(labels.withColumnsRenamed({"id": "s", "label": "_a"}), "s").join(labels.withColumnsRenamed({"id": "t", "label": "_b"}), "t").where("_a <> _b")
    contour = cut.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("contour"))
    return fidelity.crossJoin(F.broadcast(contour)).withColumn("energy", F.col("fidelity") + reg * F.col("contour"))


def _best_splits(nodes: DataFrame, both: DataFrame, reg: float, dims: int) -> DataFrame:
    """(c, id, side): of each segment c of `nodes` (c, id, n, x) the binary split that lowers the energy most, if one does.

    `both` has the edges (s, t, w) inside segments in both directions. A split begins at the mean of each of the dimensions;
    then all nodes go to the side that costs them less, for as long as that lowers the energy, so that it ends by itself.
    Splitting lowers the fidelity by n_0 n_1 / (n_0 + n_1) |mean_0 - mean_1|^2, and adds reg times the weight that it cuts.
    """
    own = [(F.col("n") * F.col("x")[j]) for j in range(dims)]
    mean = nodes.groupBy("c").agg(F.array(*[F.sum(v) / F.sum("n") for v in own]).alias("_m"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    tried = nodes.join(mean, "c").select("c", "id", "n", "x", F.posexplode(F.zip_with("x", "_m", lambda v, m: v > m)).alias("k", "new"))
    live, done = written(tried.withColumns({"side": F.lit(False), "g": F.lit(float("-inf"))})), None
    while True:
        at = live.select(F.col("id").alias("t"), "k", "new")
        pull = both.join(at, "t").groupBy(F.col("s").alias("id"), "k").agg(*[F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(p) for p, c in (("p0", ~F.col("new")), ("p1", F.col("new")))])
        now = written(live.join(pull, ["id", "k"], "left").fillna(0.0, ["p0", "p1"]))
        sides = [("0", ~F.col("new")), ("1", F.col("new"))]
        sums = [F.sum(F.when(c, F.col("n")).otherwise(0.0)).alias(f"n{i}") for i, c in sides] + [F.array(*[F.sum(F.when(c, v).otherwise(0.0)) for v in own]).alias(f"s{i}") for i, c in sides]
        cut = F.sum(F.when(F.col("new"), F.col("p0")).otherwise(F.col("p1"))) / 2
        value = now.groupBy("c", "k").agg(*sums, cut.alias("cut")).where("n0 > 0 and n1 > 0")
        value = value.select("c", "k", "n0", "n1", "cut", F.transform("s0", lambda v: v / F.col("n0")).alias("m0"), F.transform("s1", lambda v: v / F.col("n1")).alias("m1"))
        far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
        value = value.withColumn("gain", F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")) * far("m0", "m1") - reg * F.col("cut"))
        cost = [F.col("n") * far("x", f"m{i}") - reg * F.col(f"p{i}") for i in "01"]
        # the least step keeps rounding from going on for ever
        up = F.coalesce(F.col("gain") > F.col("g") + 1e-12 * F.greatest(F.lit(1.0), F.abs("gain")), F.lit(False))
        out = written(now.join(value, ["c", "k"], "left").select("c", "id", "n", "x", "k", "side", "g", "new", "gain", up.alias("up"), (cost[1] < cost[0]).alias("next")))
        ended = out.where("not up and g > 1e-9").select("c", "id", "k", "side", "g")
        done = ended if done is None else done.union(ended)
        live = out.where("up").select("c", "id", "n", "x", "k", F.col("next").alias("new"), F.col("new").alias("side"), F.col("gain").alias("g"))
        if live.isEmpty():
            break
    done = written(done)
    best = done.groupBy("c").agg(F.max_by("k", F.struct("g", -F.col("k"))).alias("k"))
    return done.join(best, ["c", "k"]).select("c", "id", "side")


#: Nodes of a segment that one task takes whole, to split it by a minimum cut.
EXACT = 5000


def cut_pursuit(nodes: DataFrame, edges: DataFrame, reg: float, exact: int = EXACT) -> DataFrame:
    """(id, label): a piecewise-constant approximation of nodes (id, n, x array) on the whole graph; label is a node's id.

    The energy is that of `partition_energy`. From the connected components on, every segment is split in two where that
    lowers the energy, and the parts are split again; segments that are not connected come apart, which costs nothing. This
    ends when no segment splits. Segments of up to `exact` nodes are split to the end by minimum cuts, in tasks that hold some of
    them (`mincut`), and those that can't gain by it (`_worth`) are not tried; larger ones are split node by node, in jobs over
    the nodes, or edges, of all of them at once, so that a segment may be of any size. Edges that repeat, in either direction,
    count with the sum of their weights.
    """
    n = written(nodes.select("id", F.col("n").cast("double").alias("n"), F.col("x").cast("array<double>").alias("x")))
    e = written(edges.where("s <> t").groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum(F.col("w").cast("double")).alias("w")))
    dims = n.agg(F.max(F.size("x"))).first()[0] or 0
    labels = components(n, e)
    active, whole, large = written(n.join(labels, "id").withColumnRenamed("label", "c")), True, False
    while True:
        while True:
            of = active.select("id", "c")
            inside = e.join(of.withColumnsRenamed({"id": "s", "c": "_a"}), "s").join(of.withColumnsRenamed({"id": "t", "c": "_b"}), "t").where("_a = _b")
            inside = written(inside.select(F.col("_a").alias("c"), "s", "t", "w"))
            tried = written(_worth(active, inside, reg, dims, whole).select("c", (F.col("_k") > exact).alias("_large")))
            of = [df.join(tried.where("not _large"), "c", "left_semi") for df in (active, inside)]
            new = mincut.settled(*of, reg).withColumnRenamed("label", "_l")
            split = None
            if not tried.where("_large").isEmpty():
                large = True
                of = [df.join(tried.where("_large"), "c", "left_semi") for df in (active, inside.select("c", "s", "t", "w"))]
                own = of[1].select("s", "t", "w")
                splits = written(_best_splits(of[0], written(own.union(own.select("t", "s", "w"))), reg, dims))
                least = splits.groupBy("c", "side").agg(F.min("id").alias("_l"))
                split = written(splits.join(least, ["c", "side"]).select("id", "_l"))
                new = new.union(split)
            labels = written(labels.join(new, "id", "left").select("id", F.coalesce("_l", "label").alias("label")))
            if split is None or split.isEmpty():
                break
            active, whole = written(n.join(split, "id").select("id", "n", "x", F.col("_l").alias("c"))), False
        if not large:
            return labels
        # segments that have come apart are tried again
        same = e.join(labels.withColumnsRenamed({"id": "s", "label": "_a"}), "s").join(labels.withColumnsRenamed({"id": "t", "label": "_b"}), "t").where("_a = _b")
        parts = labels.withColumnRenamed("label", "_was").join(components(n, same.select("s", "t")), "id")
        apart = parts.groupBy("_was").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("_was")
        again = written(parts.join(apart, "_was", "left_semi").select("id", "label"))
        labels = written(parts.select("id", "label"))
        if again.isEmpty():
            return labels
        active, whole = written(n.join(again, "id").withColumnRenamed("label", "c")), True


def _worth(nodes: DataFrame, inside: DataFrame, reg: float, dims: int, whole: bool) -> DataFrame:
    """(c, _k): the segments of nodes (c, id, n, x) that may split, and their nodes.

    A split of a connected segment (all are if `whole`) cuts its least edge or more, where edges have weights, and gains no more
    than its whole fidelity.
    """
    x = [F.col("x")[j] for j in range(dims)]
    sums = [F.sum(F.col("n") * v).alias(f"_s{j}") for j, v in enumerate(x)] + [F.sum(F.col("n") * v * v).alias(f"_q{j}") for j, v in enumerate(x)]
    of = nodes.groupBy("c").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), *sums).where("_k > 1")
    if not whole:
        return of.select("c", "_k")
    least = inside.groupBy("c").agg(F.min("w").alias("_w"))
    all_ = lambda name: reduce(Column.__add__, [name(j) for j in range(dims)], F.lit(0.0))
    square = all_(lambda j: F.col(f"_q{j}"))
    off = square - all_(lambda j: F.col(f"_s{j}") * F.col(f"_s{j}") / F.col("_n"))
    none = (F.col("_w") > 0) & (off + 1e-9 * square < reg * F.col("_w"))
    return of.join(least, "c", "left").where(~F.coalesce(none, F.lit(False))).select("c", "_k")


def instance_weights(edges: DataFrame, eps: float = 1e-3) -> DataFrame:
    """`edges` (s, t, logit) with w = a / (1 - a + eps), a the sigmoid of the affinity logit."""
    a = 1 / (1 + F.exp(-F.col("logit")))
    return edges.withColumn("w", a / (1 - a + eps))


def stuff_merged(nodes: DataFrame, stuff: list[int], keys: list[str] = ()) -> DataFrame:
    """`nodes` (label, y) where all nodes of a stuff class share one label per key: the least of them."""
    low = nodes.where(F.col("y").isin(stuff)).groupBy(*keys, "y").agg(F.min("label").alias("_l"))
    return nodes.join(low, [*keys, "y"], "left").withColumn("label", F.coalesce("_l", "label")).drop("_l")


def sweep(settings: DataFrame, metric: str, maximize: bool = True) -> DataFrame:
    """The setting with the best metric; of equals the first (smallest setting_id)."""
    sign = 1 if maximize else -1
    return settings.agg(F.max_by(F.struct(*settings.columns), F.struct(sign * F.col(metric), -F.col("setting_id"))).alias("b")).select("b.*")

