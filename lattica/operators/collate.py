"""Clouds put together and taken apart by a schema that says whose ids a column holds.

A cloud is a set of tables, name -> DataFrame. `ids` names, for each table, the columns that hold ids and the table that they
belong to: {"points": {"id": "points", "super_index": "segments"}, ...}. Such a column may also be an array. What is moved by how
much follows from that alone, so that any table, at any level, can be put together with its like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

Ids = dict[str, dict[str, str]]


def inferred(cloud: dict[str, DataFrame], ids: Ids) -> Ids:
    """`ids` with columns that it lacks: whole numbers, or arrays of them, whose name a declared column of some table has."""
    known = {c: target for columns in ids.values() for c, target in columns.items() if c not in ("id",)}
    out = {name: dict(ids.get(name, {})) for name in cloud}
    for name, df in cloud.items():
        for f in df.schema:
            kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            if f.name in known and isinstance(kind, (IntegerType, LongType)):
                out[name].setdefault(f.name, known[f.name])
    return out


def _moved(df: DataFrame, columns: dict[str, str], sign: int) -> DataFrame:
    """Columns of ids moved by the base of the table that they belong to, which is in _b_<table>."""
    out = {}
    by = lambda target: lambda v: v + sign * F.col(f"_b_{target}")
    for c, target in columns.items():
        if c in df.columns:
            array = isinstance(df.schema[c].dataType, ArrayType)
            out[c] = F.transform(c, by(target)) if array else by(target)(F.col(c))
    return df.withColumns(out).drop(*[f"_b_{t}" for t in set(columns.values())])


def collated(clouds: list[dict[str, DataFrame]], ids: Ids) -> dict[str, DataFrame]:
    """The tables of all clouds, each with a column batch. Ids of a table are moved up by what the clouds before take up: their
    largest ids plus one, summed. Tables and columns that a cloud lacks are empty, or null."""
    tables = {}
    for name in dict.fromkeys(n for c in clouds for n in c):
        own = [c[name].withColumn("batch", F.lit(b)) for b, c in enumerate(clouds) if name in c]
        tables[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
    spans = None
    for name, df in tables.items():
        for c in [c for c, target in ids.get(name, {}).items() if target == name]:
            part = df.groupBy("batch").agg((F.max(c) + 1).alias("n")).select("batch", F.lit(name).alias("table"), F.coalesce("n", F.lit(0)).alias("n"))
            spans = part if spans is None else spans.union(part)
    every = clouds[0][next(iter(clouds[0]))].sparkSession.range(len(clouds)).select(F.col("id").cast("int").alias("batch"))
    wide = every.join(spans.groupBy("batch").pivot("table", sorted(tables)).agg(F.max("n")), "batch", "left")  # one row for each cloud
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    base = wide.select("batch", *[F.coalesce(F.sum(F.coalesce(n, F.lit(0))).over(before), F.lit(0)).alias(f"_b_{n}") for n in sorted(tables)])
    out = {}
    for name, df in tables.items():
        targets = sorted(set(ids.get(name, {}).values()))
        out[name] = _moved(df.join(F.broadcast(base.select("batch", *[f"_b_{t}" for t in targets])), "batch"), ids.get(name, {}), 1)
    return out


def separated(tables: dict[str, DataFrame], batch: int, ids: Ids) -> dict[str, DataFrame]:
    """One cloud of `collated` tables again, its ids as they were."""
    bases = {}
    for name, df in tables.items():
        own = [c for c, target in ids.get(name, {}).items() if target == name]
        if own:
            bases[name] = df.where(F.col("batch") < batch).agg((F.coalesce(F.max(F.greatest(*own) if len(own) > 1 else F.col(own[0])), F.lit(-1)) + 1).alias(f"_b_{name}"))
    out = {}
    for name, df in tables.items():
        rows = df.where(F.col("batch") == batch).drop("batch")
        for target in sorted(set(ids.get(name, {}).values())):
            rows = rows.crossJoin(F.broadcast(bases[target]))  # one row
        out[name] = _moved(rows, ids.get(name, {}), -1)
    return out


def per_level(level: int | str, default, value, levels: int, start: int = 0) -> list:
    """A list for all levels with `value` at a level, at `all` from start on, at `i+` and above, or below `i-`; else default."""
    if isinstance(level, int):
        chosen = {level % levels}
    elif level == "all":
        chosen = set(range(start, levels))
    elif level[-1:] in ("+", "-") and level[:-1].isdigit():
        at = int(level[:-1])
        chosen = set(range(at, levels)) if level[-1] == "+" else set(range(at))
    else:
        raise ValueError(f"unknown level {level}")
    return [value if i in chosen else default for i in range(levels)]
