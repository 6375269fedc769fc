"""Forward passes over a hierarchy: transformer blocks and stages, composed of the operators in `nn`.

Nodes are tables (id, x, a column to normalise by, and super_index where there is a level above), x an array of doubles.
Weights are literals, given as (weight rows, bias). Batch norms are affine once a model is trained: fold them into the weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import argmax, softmax
from ..storage import written
from . import nn

Linear = tuple[list[list[float]], list[float]]


@dataclass(frozen=True)
class Block:
    """Weights of a transformer block: q and k of the same width, `out` back to the width of x, then the FFN.

    heads, rpe (from the array `a` of the edges) and scale are those of `nn.attention_heads`.
    """

    q: Linear
    k: Linear
    v: Linear
    out: Linear
    ffn: list[Linear]
    heads: int = 1
    rpe: dict[str, Linear] = field(default_factory=dict)
    scale: str = "d"


@dataclass(frozen=True)
class Stage:
    """Linear layers with leaky rectifiers, blocks, and linear layers again; each may be empty."""

    before: list[Linear] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    after: list[Linear] = field(default_factory=list)


def inject(df: DataFrame, mode: str, x: str = "x", pos: str = "pos", layers: list[Linear] = ()) -> DataFrame:
    """`df` with the positions in x: cat (positions first), add, or add_mlp (the positions' MLP is added). A null x is the positions'."""
    if mode == "cat":
        return df.withColumn(x, nn.fuse("cat", F.col(pos), F.col(x)))
    coded = df.withColumn("_pos", F.col(pos))
    if mode == "add_mlp":
        coded = nn.mlp(coded, "_pos", list(layers), last_activation=False)
    return coded.withColumn(x, nn.fuse("residual", F.col("_pos"), F.col(x))).drop("_pos")


def transformer_block(nodes: DataFrame, edges: DataFrame | None, w: Block, by: str = "graph") -> DataFrame:
    """`nodes` with x after attention over the edges and an FFN, each added to its input and fed with normalised features.

    Features are normalised over all nodes and places of a group `by`. Without an edges table there is no attention; a node
    without edges in it gets the bias of `out` only. Nodes and what attention adds are written, so that plans don't grow.
    """
    if edges is not None:
        nodes = written(nodes)
        h = nn.group_norm(nodes.select("id", by, "x"), "x", 1, by)
        qkv = h.select("id", "x", *[nn.linear(F.col("x"), *layer).alias(n) for n, layer in (("q", w.q), ("k", w.k), ("v", w.v))])
        if w.heads == 1 and not w.rpe:
            att = nn.attention(edges, written(qkv.drop("x")), len(w.q[1]))
        else:
            att = nn.attention_heads(edges, written(qkv), w.heads, w.rpe, w.scale)
        att = att.withColumnRenamed("out", "_a")
        none = F.array(*[F.lit(0.0)] * len(w.out[0][0]))
        nodes = nodes.join(att, "id", "left").withColumn("_a", nn.linear(F.coalesce("_a", none), *w.out))
        nodes = nodes.withColumn("x", nn.fuse("residual", F.col("x"), F.col("_a"))).drop("_a")
    nodes = written(nodes)
    h = nn.group_norm(nodes.withColumn("_h", F.col("x")), "_h", 1, by)
    return nn.mlp(h, "_h", w.ffn, last_activation=False).withColumn("x", nn.fuse("residual", F.col("x"), F.col("_h"))).drop("_h")


def stage(nodes: DataFrame, edges: DataFrame | None, w: Stage, by: str = "graph") -> DataFrame:
    out = nn.mlp(nodes, "x", w.before)
    for b in w.blocks:
        out = transformer_block(out, edges, b, by)
    return nn.mlp(out, "x", w.after)


def pooled(children: DataFrame, how: str) -> DataFrame:
    """(id, pooled): the children's x by super_index, place by place: sum, mean, max, min or std."""
    each = nn.pool(children.select("super_index", F.posexplode("x").alias("p", "v")).withColumn("_k", F.struct("super_index", "p")), ["v"], how, "_k")
    arrays = each.groupBy(F.col("_k.super_index").alias("id")).agg(F.sort_array(F.collect_list(F.struct("_k.p", "v"))).alias("_o"))
    return arrays.select("id", F.transform("_o", lambda y: y["v"]).alias("pooled"))


def down_stage(parents: DataFrame, children: DataFrame, edges: DataFrame | None, w: Stage, how: str = "max", mode: str = "cat", by: str = "graph") -> DataFrame:
    """`parents` after a stage over their own features and those pooled from their children; without a child, over their own."""
    rows = parents.join(pooled(children, how), "id", "left")
    return stage(rows.withColumn("x", nn.fuse(mode, F.col("x"), F.col("pooled"))).drop("pooled"), edges, w, by)


def up_stage(children: DataFrame, parents: DataFrame, edges: DataFrame | None, w: Stage, mode: str = "cat", by: str = "graph") -> DataFrame:
    """`children` after a stage over their own features and those of their parents."""
    rows = children.join(parents.select(F.col("id").alias("super_index"), F.col("x").alias("_up")), "super_index", "left")
    return stage(rows.withColumn("x", nn.fuse(mode, F.col("x"), F.col("_up"))).drop("_up"), edges, w, by)


def unet(nodes: list[DataFrame], edges: list[DataFrame | None], first: Stage, down: list[Stage], up: list[Stage], how: str = "max", mode: str = "cat", by: str = "graph") -> DataFrame:
    """The nodes of level 1 after a stage over the points, one down to each level above, and back up again.

    nodes and edges: a table for each level, points first; down: a stage for each level from 1; up: from the top but one to 1.
    """
    levels = [written(stage(nodes[0], edges[0], first, by))]
    for own, e, w in zip(nodes[1:], edges[1:], down):
        levels.append(written(down_stage(own, levels[-1], e, w, how, mode, by)))
    out = levels[-1]
    for i, w in zip(range(len(levels) - 2, 0, -1), up):
        out = up_stage(levels[i], out, edges[i], w, mode, by)
    return out


def classify(nodes: DataFrame, head: Linear) -> DataFrame:
    """(id, label, score): the class of the largest logit (ties: the first) and its share in the softmax."""
    rows = nodes.select("id", nn.linear(F.col("x"), *head).alias("_l"))
    return rows.select("id", argmax(F.col("_l")).alias("label"), F.array_max(softmax(F.col("_l"))).alias("score"))
