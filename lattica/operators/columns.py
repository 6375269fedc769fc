"""Projections: feature columns, dtypes, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType

from ..functions.noise import normal, uniform
from .ids import dense_ids


def add_keys(df: DataFrame, keys: list[str], to: str = "x", strict: bool = True, delete_after: bool = True) -> DataFrame:
    """Appends columns (numbers or arrays) to the feature array `to`, made if absent. Missing keys are an error if strict."""
    missing = [k for k in keys if k not in df.columns]
    if missing and strict:
        raise KeyError(f"no such columns: {missing}")
    keys = [k for k in keys if k not in missing]
    kinds = {f.name: f.dataType for f in df.schema}
    parts = [F.col(k).cast("array<double>") if isinstance(kinds[k], ArrayType) else F.array(F.col(k).cast("double")) for k in keys]
    if to in df.columns:
        parts = [F.col(to), *parts]
    gone = [k for k in keys if delete_after and k != to]
    return df.withColumn(to, F.concat(*parts)).drop(*gone) if parts else df


def remove_keys(df: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    missing = [k for k in keys if k not in df.columns]
    if missing and strict:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*keys)


def select_columns(df: DataFrame, key: str, idx: list[int]) -> DataFrame:
    """Keeps the named places of a feature array, in the order given."""
    return df.withColumn(key, F.array(*[F.get(key, F.lit(i)) for i in idx]))


def cast_columns(df: DataFrame, fp: str = "float", integer: str = "long", pos: str | None = None, rgb_to_float: bool = True) -> DataFrame:
    """One dtype for floats, one for integers, another for positions if asked for; byte colours become 0..1."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name in ("x", "y", "z") and pos:
            c = c.cast(pos)
        elif f.name in ("r", "g", "b") and rgb_to_float and isinstance(f.dataType, (ShortType, IntegerType, LongType)):
            c = (c / 255.0).cast(fp)
        elif isinstance(f.dataType, (FloatType, DoubleType)):
            c = c.cast(fp)
        elif isinstance(f.dataType, (ShortType, IntegerType, LongType)) and not isinstance(f.dataType, BooleanType):
            c = c.cast(integer)
        out.append(c.alias(f.name))
    return df.select(*out)


def save_node_index(df: DataFrame, order: str, key: str = "node_id") -> DataFrame:
    """`df` with a row number from 0 in the order of a unique column."""
    return dense_ids(df, [order], key)


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """A random order that is the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)


def dropout_columns(df: DataFrame, key: str, drop: list[int], to_mean: bool = False) -> DataFrame:
    """Zeroes the named places of a feature array, or sets them to their mean over all rows."""
    if not to_mean:
        return df.withColumn(key, F.transform(key, lambda v, i: F.when(i.isin(drop), F.lit(0.0)).otherwise(v)))
    means = F.broadcast(df.agg(F.array(*[F.avg(F.get(key, F.lit(i))) for i in drop]).alias("_m")))
    spot = F.create_map(*[x for p, i in enumerate(drop) for x in (F.lit(i), F.lit(p))])
    return df.crossJoin(means).withColumn(key, F.transform(key, lambda v, i: F.when(i.isin(drop), F.get("_m", F.try_element_at(spot, i))).otherwise(v))).drop("_m")


def dropout_rows(df: DataFrame, key: str, p: float, seed: int = 0, by: str = "pid", to_mean: bool = False) -> DataFrame:
    """Zeroes the feature array of a share p of the rows, or sets it to its mean over all rows; drawn by the id."""
    drop = uniform(seed, by) < p
    if not to_mean:
        return df.withColumn(key, F.when(drop, F.transform(key, lambda v: F.lit(0.0))).otherwise(F.col(key)))
    mean = df.select(F.posexplode(key).alias("_p", "_v")).groupBy("_p").agg(F.avg("_v").alias("_v"))
    mean = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda e: e["_v"]).alias("_m"))  # one row for each place
    return df.crossJoin(F.broadcast(mean)).withColumn(key, F.when(drop, F.col("_m")).otherwise(F.col(key))).drop("_m")


def jitter(df: DataFrame, columns: list[str], sigma: float = 0.01, trunc: float = 0.05, seed: int = 0, by: str = "pid") -> DataFrame:
    """Adds normal noise, clipped to +-trunc if that is positive; drawn by the id and the column's name, so that it doesn't
    depend on how rows are partitioned."""
    for c in columns:
        noise = normal(seed, by, F.lit(c)) * sigma
        df = df.withColumn(c, F.col(c) + (F.greatest(F.lit(-trunc), F.least(F.lit(trunc), noise)) if trunc > 0 else noise))
    return df


def jitter_levels(levels: list[DataFrame], columns: list[str], sigma, trunc=0.05, seed: int = 0, by: str = "id") -> list[DataFrame]:
    """`jitter` of the nodes of each level of a hierarchy. sigma, trunc: one for all levels, or a list; no noise where sigma is 0
    or less. Columns that a level lacks are passed over."""
    each = lambda v: list(v) if isinstance(v, (list, tuple)) else [v] * len(levels)
    made = []
    for i, (df, s, t) in enumerate(zip(levels, each(sigma), each(trunc))):
        made.append(jitter(df, [c for c in columns if c in df.columns], s, t, seed + i, by) if s > 0 else df)
    return made


def norm_index(df: DataFrame, mode: str = "graph", id: str = "id", graph: str = "batch", parent: str = "super_index") -> DataFrame:
    """`df` with norm_index, what features are normalised by: the graph, the node itself, or its segment in its graph."""
    if mode == "segment":
        n = F.broadcast(df.agg((F.max(graph) + 1).alias("_n")))
        return df.crossJoin(n).withColumn("norm_index", F.col(parent) * F.col("_n") + F.col(graph)).drop("_n")
    return df.withColumn("norm_index", F.col({"graph": graph, "node": id}[mode]))


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted, whatever their order."""
    if set(a.columns) != set(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
