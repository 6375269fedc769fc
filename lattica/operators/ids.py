"""Dense ids, ranks and running sums, made without sorting everything, or a whole group, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with `name`: the rank from 0 of its keys among all distinct keys.

    The distinct keys are range-partitioned and numbered within their partitions; a partition's first number is the sum of
    the counts before it, one row per partition. Null keys are ranked first, as one key.
    """
    ranked = written(df.select(*keys).distinct().repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    counts = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    ranked = ranked.withColumn("_r", own).join(F.broadcast(base), "_p")
    ranked = ranked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_r") - 1 + F.coalesce("_base", F.lit(0))).cast("long").alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(ranked, on).drop(*[f"_k_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank", sums: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `name`: each row's place from 1 within its keys, by `order`; and `sum_<c>`, the running sum of c to there.

    Rows are range-partitioned by keys and order, so that a group of any size is spread over many tasks; a part begins where
    the parts before it end, which is known from one row per key and part. Make the order unique. Null keys are a group.
    """
    rows = written(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    part = Window.partitionBy(*keys, "_p").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    base = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_p").alias("_part"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_n", *[f"_s{i}" for i in range(len(sums))])],
    )
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_r": F.row_number().over(part), **{f"_u{i}": F.sum(c).over(upto) for i, c in enumerate(sums)}})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_p") == F.col("_part")]
    made = [(F.col("_r") + F.col("_b_n")).cast("long").alias(name)] + [(F.col(f"_u{i}") + F.col(f"_b_s{i}")).alias(f"sum_{c}") for i, c in enumerate(sums)]
    return rows.join(base, on).select(*df.columns, *made)


def lower_median(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """(keys, median): the lower median of each group's values, one row without keys; groups without a value have none.

    Equal values are counted first, so that any number of them is one row; the running sums of the counts are made in parts.
    """
    keys = list(keys)
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    upto = ranked(counts, keys, [value], "_k", ("_c",))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_all")).select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_all")
    rows = upto.join(total, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]) if keys else upto.crossJoin(F.broadcast(total))
    return rows.where("2 * sum__c >= _all").groupBy(*keys).agg(F.min(value).alias("median")).where("median is not null")
