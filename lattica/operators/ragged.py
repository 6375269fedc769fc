"""Ragged arrays and batches. In long form a group is a key; array form is for the edges of the API."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import dense_ids, ranked


def to_lists(df: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """(group, values): each group's rows as an array of structs in their order."""
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*values).alias("_v")))).alias("_l"))
    return rows.select(group, F.transform("_l", lambda x: x["_v"]).alias("values"))


def from_lists(df: DataFrame, group: str, values: str = "values") -> DataFrame:
    """(group, pos, ...): the arrays as rows again."""
    rows = df.select(group, F.posexplode(values).alias("pos", "_v"))
    return rows.select(group, "pos", "_v.*")


def sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def take(df: DataFrame, group: str, wanted: DataFrame) -> DataFrame:
    """The groups of an ordered list (pos, <group>), under their places in it; a group may be taken twice."""
    return wanted.select(F.col(group), "pos").join(df, group).withColumn("new_group", F.col("pos")).drop("pos")


def with_empty_groups(df: DataFrame, group: str, total: int) -> DataFrame:
    """(group, values): array form with an empty array for each number below `total` that has no group."""
    every = df.sparkSession.range(total).select(F.col("id").alias(group))
    empty = F.array().cast(df.schema["values"].dataType)
    return every.join(df, group, "left").select(group, F.coalesce("values", empty).alias("values"))


def inverted(lists: DataFrame, parent: str, children: str) -> DataFrame:
    """(id, super_index) from each parent's list of children."""
    return lists.select(F.explode(children).alias("id"), F.col(parent).alias("super_index"))


def pointers(df: DataFrame, group: str) -> DataFrame:
    """(group, size, start): where each group begins if they are laid end to end. `df` holds a row per group and its size."""
    return ranked(df, [], [group], "_rank", ("size",)).withColumn("start", F.col("sum_size") - F.col("size")).drop("_rank", "sum_size")


def dense_to_long(df: DataFrame, id: str, array: str) -> DataFrame:
    """(id, col, val): the entries of an array that aren't 0."""
    return df.select(id, F.posexplode(array).alias("col", "val")).where("val <> 0")


def long_to_dense(df: DataFrame, id: str, width: int, fill: float = 0.0) -> DataFrame:
    """(id, values): arrays of `width` from (id, col, val), with `fill` where there is nothing."""
    at = [F.coalesce(F.max(F.when(F.col("col") == i, F.col("val"))), F.lit(fill)) for i in range(width)]
    return df.groupBy(id).agg(F.array(*at).alias("values"))


def interleaved_ranges(df: DataFrame, width: str, start: str) -> DataFrame:
    """A row for each number start .. start + width - 1 of each row; none where the width is 0."""
    rows = df.where(F.col(width) > 0)
    return rows.select("*", F.explode(F.sequence(F.col(start), F.col(start) + F.col(width) - 1)).alias("value"))


def repeated(df: DataFrame, times: str) -> DataFrame:
    rows = df.where(F.col(times) > 0)
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))).alias("_i")).drop("_i")


def batch_union(parts: list[DataFrame], index: list[str]) -> DataFrame:
    """The union of tables with `batch`; the columns `index` are moved up by the sum of the earlier maxima plus one."""
    rows = None
    for b, part in enumerate(parts):
        part = part.withColumn("batch", F.lit(b))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    span = rows.groupBy("batch").agg(*[(F.coalesce(F.max(c), F.lit(-1)) + 1).alias(f"_n_{c}") for c in index])
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # one row per table
    base = span.select("batch", *[F.coalesce(F.sum(f"_n_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in index])
    out = rows.join(F.broadcast(base), "batch")
    return out.withColumns({c: F.col(c) + F.col(f"_o_{c}") for c in index}).drop(*[f"_o_{c}" for c in index])


def batch_part(df: DataFrame, batch: int, index: list[str]) -> DataFrame:
    """One table of a batch again, its index columns from 0 (its smallest values become 0)."""
    own = df.where(F.col("batch") == batch).drop("batch")
    low = F.broadcast(own.agg(*[F.min(c).alias(f"_l_{c}") for c in index]))
    return own.crossJoin(low).withColumns({c: F.col(c) - F.col(f"_l_{c}") for c in index}).drop(*[f"_l_{c}" for c in index])


def disjoint(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, splits): ids that are in more than one split."""
    rows = None
    for name, df in splits.items():
        part = df.select(key).distinct().withColumn("split", F.lit(name))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def id_checks(df: DataFrame, id: str) -> DataFrame:
    """One row: n, is_dense (0..max all occur), has_duplicates, is_permutation."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id).alias("d"), F.min(id).alias("lo"), F.max(id).alias("hi"))
    dense = (F.col("lo") == 0) & (F.col("hi") == F.col("d") - 1)
    return s.select("n", dense.alias("is_dense"), (F.col("d") < F.col("n")).alias("has_duplicates"), (dense & (F.col("d") == F.col("n"))).alias("is_permutation"))


def is_sorted(df: DataFrame, by: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, is_sorted): whether a value never falls along `by` within its keys."""
    rows = ranked(df.select(*keys, by, value), keys, [by], "_r")
    after = rows.select(*keys, (F.col("_r") - 1).alias("_r"), F.col(value).alias("_next"))
    step = F.col("_next") - F.col(value)
    return rows.join(after, [*keys, "_r"], "left").groupBy(*keys).agg((F.coalesce(F.min(step), F.lit(0)) >= 0).alias("is_sorted"))


def reindexed_lists(df: DataFrame, group: str, value: str) -> DataFrame:
    """`df` with dense ids for groups and for values."""
    out = dense_ids(df, [group], "new_group")
    return dense_ids(out, [value], "new_value")
