"""Helpers that every training-data operator shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, and tab to carriage return.
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that `df` doesn't have (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = f"_{base}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's `spark.checkpoint.dir`.

    Where that is unset, a temporary folder stands in on a local master; on a cluster, where it would not be shared, this
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lattica-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors.

    The shuffle files of the write go as soon as the table is there.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` has made and that nothing reads any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(doc_id: str, text: str) -> Column:
    """A hash of a row's id and text, so that texts whose ids are null, or repeat, are told apart."""
    return F.xxhash64(doc_id, text)


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; empty for a null text or one without words."""
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WS_RUN)).otherwise(F.array().cast("array<string>"))
