"""Tables in the cluster's shared folder: the way to cut lineage that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`.

    Where that is unset, a temporary folder stands in on a local master; on a cluster, where it would not be shared, this
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lattica-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder. The shuffle files of the write go as soon as the table is there."""
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
    """Deletes tables that `written` has made and that nothing reads any more; other tables are left as they are."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
