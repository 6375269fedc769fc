"""Sparse convolutions over occupied cells, by a rulebook that all layers of a resolution share.

Cells are tables (id, cx, cy, cz) and any keys that keep clouds apart; features are tables (id, x), x an array of channels.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import dot
from ..storage import written
from . import nn

XYZ = ("cx", "cy", "cz")


@dataclass(frozen=True)
class Rulebook:
    """rows: which input cell (i) an output cell (o) sees at which place (k) of the kernel. cells: the output cells."""

    rows: DataFrame
    cells: DataFrame


def offsets(size: int, dilation: int = 1) -> list[tuple[int, int, int]]:
    """The places of a cubic kernel, x first: around the cell for an odd size, from it on for an even one."""
    low = -(size // 2) if size % 2 else 0
    return [tuple(dilation * v for v in o) for o in product(range(low, low + size), repeat=3)]


def rulebook(cells: DataFrame, size: int = 3, stride: int = 1, dilation: int = 1, keys: list[str] = ()) -> Rulebook:
    """The rules of a convolution over cells, made once and written.

    At stride 1 the output cells are the input cells. Otherwise they are those of a grid as many times coarser, known by the
    least id in them, and see the input from their low corner on. A cell meets its neighbours by an equi-join on the cell.
    """
    names, keys = [*keys, *XYZ], list(keys)
    out = cells.select("id", *names)
    if stride > 1:
        out = out.select("id", *keys, *[F.floor(F.col(c) / stride).alias(c) for c in XYZ]).groupBy(*names).agg(F.min("id").alias("id"))
    out = written(out)
    spots = [F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(f"_{c}") for c, v in zip(XYZ, o)]) for k, o in enumerate(offsets(size, dilation))]
    seen = cells.select(F.col("id").alias("i"), *names, F.inline(F.array(*spots)))
    seen = seen.withColumns({c: F.col(c) - F.col(f"_{c}") for c in XYZ})
    if stride > 1:
        seen = seen.where(" and ".join(f"pmod({c}, {stride}) = 0" for c in XYZ)).withColumns({c: (F.col(c) / stride).cast("long") for c in XYZ})
    target = out.select(F.col("id").alias("o"), *[F.col(c).cast("long").alias(c) if c in XYZ else F.col(c) for c in names])
    return Rulebook(written(seen.withColumns({c: F.col(c).cast("long") for c in XYZ}).join(target, names).select("i", "o", "k")), out)


def convolve(features: DataFrame, rules: Rulebook, weight: list[list[list[float]]], bias: list[float] | None = None) -> DataFrame:
    """(id, x) of the output cells. weight: for each place of the kernel, a row of input weights for each output channel."""
    channels = len(weight[0])
    table = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in place]) for place in weight])
    seen = rules.rows.join(features.select(F.col("id").alias("i"), "x"), "i")
    made = seen.select("o", F.transform(F.get(table, F.col("k")), lambda row: dot(row, F.col("x"))).alias("y"))
    sums = made.groupBy(F.col("o").alias("id")).agg(*[F.sum(F.get("y", F.lit(j))).alias(f"_{j}") for j in range(channels)])
    return sums.select("id", F.array(*[F.col(f"_{j}") + float(bias[j] if bias else 0) for j in range(channels)]).alias("x"))


@dataclass(frozen=True)
class ConvBlock:
    """A convolution, then channels normalised over each cloud, the input added (residual) and a leaky rectifier.

    norm: (weight, bias) of the channels, or None. slope: of the rectifier below 0; None for no rectifier.
    """

    weight: list[list[list[float]]]
    bias: list[float] | None = None
    size: int = 3
    stride: int = 1
    dilation: int = 1
    norm: tuple[list[float], list[float]] | None = None
    residual: bool = False
    slope: float | None = 0.0


def block(features: DataFrame, rules: Rulebook, w: ConvBlock, by: str | None = None) -> DataFrame:
    """(id, x) of the output cells after a block; `by`: a column of the rulebook's cells to normalise by, or all at once."""
    out = convolve(features, rules, w.weight, w.bias)
    if w.norm:
        group = F.lit(0) if by is None else F.col(by)
        out = out.join(rules.cells.select("id", *([by] if by else [])), "id").select("id", group.alias("_by"), "x")
        out = nn.group_norm(out, "x", len(w.weight[0]), "_by").select("id", "x")
        scale, shift = (F.array(*[F.lit(float(v)) for v in part]) for part in w.norm)
        out = out.select("id", F.zip_with(F.zip_with("x", scale, lambda a, b: a * b), shift, lambda a, b: a + b).alias("x"))
    if w.residual:
        out = out.join(features.select("id", F.col("x").alias("_in")), "id").select("id", F.zip_with("x", "_in", lambda a, b: a + b).alias("x"))
    return out if w.slope is None else out.withColumn("x", nn.leaky_relu(F.col("x"), w.slope))


def cnn(cells: DataFrame, blocks: list[ConvBlock], by: str | None = None, keys: list[str] = (), residual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, cells) after blocks over cells (id, cx, cy, cz, x). Blocks of one geometry share their rulebook for as long as
    the resolution stays; residual: the input is added to the output, whose cells have to be the input's."""
    features, books = cells.select("id", "x"), {}
    first, cells = features, cells.select("id", *keys, *([by] if by and by not in keys else []), *XYZ)
    names = [*keys, *([by] if by and by not in keys else [])]
    for w in blocks:
        geometry = (w.size, w.stride, w.dilation)
        if geometry not in books:
            books[geometry] = rulebook(cells, *geometry, keys=names)
        rules = books[geometry]
        features = written(block(features, rules, w, by))
        if w.stride > 1:
            cells, books = rules.cells, {}
    if residual:
        features = features.join(first.select("id", F.col("x").alias("_in")), "id").select("id", F.zip_with("x", "_in", lambda a, b: a + b).alias("x"))
    return features, cells
