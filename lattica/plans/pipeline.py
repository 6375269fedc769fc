"""Pipelines as data: an ordered list of named operators with parameters, hashed for caching."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import columns, sampling, voxels

REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "add_keys": columns.add_keys,
    "remove_keys": columns.remove_keys,
    "select_columns": columns.select_columns,
    "cast_columns": columns.cast_columns,
    "dropout_columns": columns.dropout_columns,
    "grid_sampling": voxels.grid_sampling,
    "xy_partition": voxels.xy_partition,
    "xyz_partition": voxels.xyz_partition,
    "xy_tile": sampling.xy_tile,
    "sparse_sample": sampling.sparse_sample,
}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Adds an operator: a function from a DataFrame and keyword parameters to a DataFrame."""
    REGISTRY[name] = f


def flattened(spec: list) -> list[dict]:
    """Nested lists of steps as one list."""
    return [s for x in spec for s in (flattened(x) if isinstance(x, list) else [x])]


def pipeline(spec: list) -> Callable[[DataFrame], DataFrame]:
    """One function from steps {"transform": name, "params": {...}}."""
    steps = [(REGISTRY[s["transform"]], s.get("params", {})) for s in flattened(spec)]

    def run(df: DataFrame) -> DataFrame:
        for f, params in steps:
            df = f(df, **params)
        return df

    return run


def spec_hash(spec: list) -> str:
    """MD5 of the flattened spec as canonical JSON."""
    return hashlib.md5(json.dumps(flattened(spec), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cached(spark: SparkSession, df: DataFrame, spec: list, root: str) -> DataFrame:
    """The pipeline's result over `df` from root/<hash>, computed and written there if it isn't yet."""
    path = f"{root}/{spec_hash(spec)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        pipeline(spec)(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sanitized_keys(keys, default=()) -> tuple[str, ...]:
    return tuple(sorted(set(keys if keys is not None else default)))
