"""A small Spark session, and DuckDB over the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function from a folder of tables to a DuckDB connection over them."""

    def connect(sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return con

    return connect


def _key(row):
    return tuple((v is not None, round(v, 5) if isinstance(v, float) else v) for v in row)


def same_rows(spark_df, relation, tolerance=2e-5):
    """Whether a DataFrame and a DuckDB result hold the same rows, by column name."""
    names = sorted(spark_df.columns)
    assert names == sorted(relation.columns), (names, relation.columns)
    a = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=lambda r: str(_key(r)))
    at = [relation.columns.index(n) for n in names]
    b = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=lambda r: str(_key(r)))
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        for n, u, v in zip(names, x, y):
            if isinstance(u, float) and isinstance(v, (int, float)):
                assert abs(u - v) <= tolerance * max(1, abs(u)), (n, x, y)
            else:
                assert u == v, (n, x, y)
