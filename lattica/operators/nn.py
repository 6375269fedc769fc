"""Inference operators and losses over tables: attention, pooling, norms, heads; weights are literals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import dot, softmax
from .ids import ranked


def pool(children: DataFrame, values: list[str], how: str, parent: str = "super_index") -> DataFrame:
    """(parent, values): sum, mean, max, min or std of the children; one child has a deviation of 0."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))}[how]
    return children.groupBy(parent).agg(*[f(v).alias(v) for v in values])


def unpool(children: DataFrame, parents: DataFrame, values: list[str]) -> DataFrame:
    """Each child with its parent's values. parents: id and values."""
    return children.join(parents.select(F.col("id").alias("super_index"), *[F.col(v).alias(f"parent_{v}") for v in values]), "super_index")


def fuse(mode: str, a: Column, b: Column) -> Column:
    """Two feature arrays: cat, residual (sum), first or second; a missing side gives the other."""
    made = {"cat": F.concat(a, b), "residual": F.zip_with(a, b, lambda x, y: x + y), "first": a, "second": b}[mode]
    return F.coalesce(made, a, b)


def edge_softmax(edges: DataFrame, score: str = "score", by: list[str] = ("s",)) -> DataFrame:
    """`edges` with `a`: the softmax of the scores of each source's edges. Sums join back; no group is gathered."""
    by = list(by)
    top = edges.groupBy(*by).agg(F.max(score).alias("_top"))
    e = edges.join(top, by).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = e.groupBy(*by).agg(F.sum("_e").alias("_sum"))
    return e.join(total, by).withColumn("a", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def attention(edges: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(id, out): sparse attention; nodes have arrays q, k, v; out sums v over a node's edges by softmax(q k / sqrt(dim))."""
    e = edges.select("s", "t").join(nodes.select(F.col("id").alias("s"), "q"), "s").join(nodes.select(F.col("id").alias("t"), "k", "v"), "t")
    e = edge_softmax(e.select("s", "t", "v", (dot(F.col("q"), F.col("k")) / math.sqrt(dim)).alias("score")))
    each = e.select("s", "a", F.posexplode("v").alias("p", "x")).groupBy("s", "p").agg(F.sum(F.col("a") * F.col("x")).alias("x"))
    return each.groupBy(F.col("s").alias("id")).agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("_o")).select("id", F.transform("_o", lambda y: y["x"]).alias("out"))


#: Terms that relative positions add, and what they are computed from.
RPE = {"k": "a", "q": "a", "v": "a", "k_delta": "delta", "q_delta": "delta"}


def attention_heads(edges: DataFrame, nodes: DataFrame, heads: int, rpe: dict[str, tuple] | None = None, scale: str = "d", q_on_minus: bool = False) -> DataFrame:
    """(id, out): sparse attention with heads and relative positions over edges (s, t, and an array a of features, if any).

    nodes: id and arrays q, k, v, each the heads' parts in a row; x as well for delta terms. rpe: linear layers (weight rows,
    bias) that add to k, q or v from the edge's a (`k`, `q`, `v`) or from x_t - x_s (`k_delta`, `q_delta`); a layer as wide as
    one head serves all heads. q is scaled by the width of a head (`d`), the number of the node's edges (`g`), both (`d.g`,
    `d+g`) or neither (an empty string), before terms are added. q_on_minus: terms of q take what they see negated.

    Edges come sorted by s from the join with q, and are summed in one pass, by batches: a node's sums are scaled down when a
    larger score turns up. Where a node's edges lie in several tasks, their sums meet in one row for each task; so a hub's
    edges are never gathered. Nodes without edges have no row.
    """
    rpe = {k: (np.array(w, float), np.array(b, float)) for k, (w, b) in (rpe or {}).items()}
    delta = any(RPE[k] == "delta" for k in rpe)
    own, others = nodes.select(F.col("id").alias("s"), "q", *([F.col("x").alias("xs")] if delta else [])), nodes.select(F.col("id").alias("t"), "k", "v", *([F.col("x").alias("xt")] if delta else []))
    if "g" in scale:
        own = own.join(edges.groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("g")), "s")
    e = edges.select("s", "t", *(["a"] if any(RPE[k] == "a" for k in rpe) else [])).join(others, "t").join(own, "s")

    def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return np.asarray(batch.column(name).flatten(), float).reshape(batch.num_rows, -1)

    def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n, part = batch.num_rows, {c: matrix(batch, c) for c in "qkv"}
        width = part["q"].shape[1] // heads
        root = np.sqrt(np.asarray(batch.column("g"), float))[:, None] if "g" in scale else 1.0
        part["q"] = part["q"] / {"": 1.0, "d": np.sqrt(width), "g": root, "d.g": np.sqrt(width) * root, "d+g": np.sqrt(width) + root}[scale]
        for name, (weight, bias) in rpe.items():
            seen = matrix(batch, "a") if RPE[name] == "a" else matrix(batch, "xt") - matrix(batch, "xs")
            term = (-seen if q_on_minus and name[0] == "q" else seen) @ weight.T + bias
            to = part[name[0]]
            part[name[0]] = to + np.tile(term, (1, to.shape[1] // term.shape[1]))
        score = (part["q"] * part["k"]).reshape(n, heads, width).sum(axis=2)
        return score, part["v"].reshape(n, heads, -1)

    def rows(s: np.ndarray, m: np.ndarray, z: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.size // max(1, len(x)) or 1, dtype=np.int32), x.ravel())
        return pa.RecordBatch.from_arrays([pa.array(s), lists(m), lists(z), lists(o.reshape(len(o), -1))], ["id", "m", "z", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, (score, v) = np.asarray(batch.column("s")), scored(batch)
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            ids, size = s[at], np.diff(np.r_[at, len(s)])
            m = np.maximum.reduceat(score, at, axis=0)
            w = np.exp(score - np.repeat(m, size, axis=0))
            z, o = np.add.reduceat(w, at, axis=0), np.add.reduceat(w[:, :, None] * v, at, axis=0)
            if last is not None and last[0][0] == ids[0]:
                top = np.maximum(last[1][0], m[0])
                a, b = np.exp(last[1][0] - top), np.exp(m[0] - top)
                m[0], z[0], o[0] = top, a * last[2][0] + b * z[0], a[:, None] * last[3][0] + b[:, None] * o[0]
            elif last is not None:
                yield rows(*last)
            if len(ids) > 1:
                yield rows(ids[:-1], m[:-1], z[:-1], o[:-1])
            last = ids[-1:], m[-1:], z[-1:], o[-1:]
        if last is not None:
            yield rows(*last)

    parts = e.mapInArrow(run, f"id {dict(nodes.dtypes)['id']}, m array<double>, z array<double>, o array<double>")
    met = parts.groupBy("id").agg(F.collect_list(F.struct("m", "z", "o")).alias("p"))
    head = lambda p, name, h: F.get(p[name], h)
    top = met.withColumn("top", F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.array_max(F.transform("p", lambda p: head(p, "m", h)))))
    share = lambda p, h: F.exp(head(p, "m", h) - F.get("top", h))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, p: acc + f(p))
    width = F.size(F.get("p", F.lit(0))["o"])
    at = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(i.alias("i"), F.floor(i * heads / width).cast("int").alias("h")))
    out = F.transform(at, lambda x: total(lambda p: share(p, x["h"]) * F.get(p["o"], x["i"])) / total(lambda p: share(p, x["h"]) * head(p, "z", x["h"])))
    return top.select("id", out.alias("out"))


def attentive_pool(children: DataFrame, parents: DataFrame | None, dim: int, query: list[float] | None = None) -> DataFrame:
    """(id, out): attention of a parent's query (its q, or one literal for all) over its children's k and v."""
    e = children.select("id", "super_index", "k", "v")
    q = F.array(*[F.lit(float(x)) for x in query]) if query is not None else F.col("q")
    if query is None:
        e = e.join(parents.select(F.col("id").alias("super_index"), "q"), "super_index")
    e = edge_softmax(e.select(F.col("super_index").alias("s"), "v", (dot(q, F.col("k")) / math.sqrt(dim)).alias("score")))
    each = e.select("s", "a", F.posexplode("v").alias("p", "x")).groupBy("s", "p").agg(F.sum(F.col("a") * F.col("x")).alias("x"))
    return each.groupBy(F.col("s").alias("id")).agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("_o")).select("id", F.transform("_o", lambda y: y["x"]).alias("out"))


def linear(x: Column, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    """weight x + bias, weight given row by row."""
    rows = [dot(x, F.array(*[F.lit(float(v)) for v in row])) for row in weight]
    return F.array(*[r + float(b) for r, b in zip(rows, bias)] if bias else rows)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.transform(x, lambda v: F.when(v < 0, v * slope).otherwise(v))


def mlp(df: DataFrame, x: str, layers: list[tuple[list[list[float]], list[float]]], last_activation: bool = True) -> DataFrame:
    """Linear layers with leaky rectifiers between; each is a projection of its own, so that no layer is evaluated twice."""
    for i, (w, b) in enumerate(layers):
        df = df.withColumn(x, linear(F.col(x), w, b))
        if last_activation or i < len(layers) - 1:
            df = df.withColumn(x, leaky_relu(F.col(x)))
    return df


def group_norm(df: DataFrame, x: str, groups: int, by: str = "graph", eps: float = 1e-5) -> DataFrame:
    """Feature arrays normalised by the mean and variance of each group of places over each graph."""
    rows = df.select(by, F.posexplode(x).alias("_p", "_v"), F.size(x).alias("_w")).withColumn("_g", F.floor(F.col("_p") * groups / F.col("_w")))
    s = rows.groupBy(by, "_g").agg(F.avg("_v").alias("_m"), F.var_pop("_v").alias("_var"))
    s = s.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_g", "_m", "_var"))).alias("_s"))
    at = lambda i: F.get("_s", F.floor(i * groups / F.size(x)).cast("int"))
    return df.join(s, by).withColumn(x, F.transform(x, lambda v, i: (v - at(i)["_m"]) / F.sqrt(at(i)["_var"] + eps))).drop("_s")


def batch_norm(df: DataFrame, cols: list[str], eps: float = 1e-5) -> DataFrame:
    s = F.broadcast(df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop))]))
    return df.crossJoin(s).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.sqrt(F.col(f"_v_{c}") + eps) for c in cols}).drop(*[f"_{n}_{c}" for c in cols for n in "mv"])


def sparse_conv(cells: DataFrame, kernel: dict[tuple[int, int, int], float], value: str = "v") -> DataFrame:
    """(cx, cy, cz, out): a convolution on occupied integer cells: the weighted sum of values at the kernel's offsets."""
    spark = cells.sparkSession
    k = spark.createDataFrame([(*o, float(w)) for o, w in kernel.items()], "ox int, oy int, oz int, w double")
    moved = cells.crossJoin(F.broadcast(k)).select(*[(F.col(f"c{d}") - F.col(f"o{d}")).alias(f"c{d}") for d in "xyz"], (F.col("w") * F.col(value)).alias("p"))
    sums = moved.groupBy("cx", "cy", "cz").agg(F.sum("p").alias("out"))
    return sums.join(cells.select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi")


def accumulate_runs(runs: DataFrame, id: str, logits: list[str]) -> DataFrame:
    """Sums of the logits of several runs by node."""
    return runs.groupBy(id).agg(*[F.sum(c).alias(c) for c in logits])


def focal_loss(df: DataFrame, logits: str, target: str, gamma: float = 2.0, weights: list[float] | None = None, ignore: int = -100) -> DataFrame:
    """One row `loss`: the mean of w (1 - p)^gamma (-ln p) over the rows, w normalised over all rows before some are ignored."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col(target) + 1) if weights else F.lit(1.0)
    p = F.get(softmax(F.col(logits)), F.col(target))
    rows = df.withColumn("_w", F.when(F.col(target) == ignore, F.lit(0.0)).otherwise(w)).withColumn("_p", F.when(F.col(target) == ignore, F.lit(1.0)).otherwise(p))
    return rows.agg((F.sum(F.col("_w") * F.pow(1 - F.col("_p"), F.lit(gamma)) * -F.log("_p")) / F.sum("_w")).alias("loss"))


def binary_focal_loss(df: DataFrame, logit: str, target: str, gamma: float = 0.0, weight: float = 0.5, eps: float = 1e-6) -> DataFrame:
    p = (1 / (1 + F.exp(-F.col(logit)))) * (1 - 2 * eps) + eps
    y = F.col(target)
    each = -(weight * y * F.pow(1 - p, F.lit(gamma)) * F.log(p) + (1 - weight) * (1 - y) * F.pow(p, F.lit(gamma)) * F.log(1 - p))
    return df.agg(F.avg(each).alias("loss"))


def bce_loss(df: DataFrame, logit: str, target: str, weight: str | None = None, pos_weight: float = 1.0) -> DataFrame:
    """One row `loss`: the weighted mean of binary cross-entropies of logits, in the form that doesn't overflow."""
    x, y, w = F.col(logit), F.col(target), F.col(weight) if weight else F.lit(1.0)
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return df.agg((F.sum(w * ((1 - y) * x + (1 + (pos_weight - 1) * y) * soft)) / F.sum(w)).alias("loss"))


def lovasz_loss(df: DataFrame, id: str, errors: str, truth: str, cls: str) -> DataFrame:
    """(class, loss) from rows (id, class, error, truth 0/1): errors in falling order times the steps of the Jaccard index.

    Rows are ranked in parts, so that a class of any size is spread over many tasks.
    """
    total = df.groupBy(cls).agg(F.sum(truth).alias("_g"))
    rows = ranked(df.select(id, cls, errors, F.col(truth).alias("_t")), [cls], [F.desc(errors), id], "_k", ("_t",))
    rows = rows.join(F.broadcast(total), cls).where("_g > 0")
    # the Jaccard index after a row and before it, both from the row's own rank and sum
    jaccard = lambda k, c: 1 - (F.col("_g") - c) / (F.col("_g") + k - c)
    step = jaccard(F.col("_k"), F.col("sum__t")) - jaccard(F.col("_k") - 1, F.col("sum__t") - F.col("_t"))
    return rows.groupBy(cls).agg(F.sum(step * F.col(errors)).alias("loss"))


def histogram_loss(df: DataFrame, logits: str, hist: str) -> DataFrame:
    """One row `loss`: cross-entropy where every count of a row's label histogram is a weighted target."""
    rows = df.withColumn("_p", softmax(F.col(logits))).select("_p", F.posexplode(hist).alias("_c", "_n")).where("_n > 0")
    return rows.agg((F.sum(-F.log(F.get("_p", F.col("_c"))) * F.col("_n")) / F.sum("_n")).alias("loss"))


def combined_loss(losses: list[tuple[float, DataFrame]]) -> DataFrame:
    out = None
    for factor, df in losses:
        part = df.select((F.col("loss") * factor).alias("loss"))
        out = part if out is None else out.union(part)
    return out.agg(F.sum("loss").alias("loss"))


def affinity_weights(same_class: Column, same_obj: Column, weights: tuple[float, float, float, float]) -> Column:
    """One of four weights: same class and object, same class only, same object only, neither."""
    return F.when(same_class & same_obj, weights[0]).when(same_class, weights[1]).when(same_obj, weights[2]).otherwise(weights[3])


def instance_prediction(nodes: DataFrame, instance: str, logits: str, size: str) -> DataFrame:
    """(instance, label, score): the softmax of the size-weighted mean logits of each instance's nodes."""
    each = nodes.select(instance, size, F.posexplode(logits).alias("p", "x")).groupBy(instance, "p").agg((F.sum(F.col("x") * F.col(size)) / F.sum(size)).alias("x"))
    arr = each.groupBy(instance).agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("_o")).select(instance, F.transform("_o", lambda y: y["x"]).alias("_m")).withColumn("_s", softmax(F.col("_m")))
    return arr.select(instance, (F.array_position("_s", F.array_max("_s")) - 1).cast("int").alias("label"), F.array_max("_s").alias("score"))
