"""Queries over the driver's tables, one or more for each operator of the library."""

from . import graph_queries, instance_queries, model_queries, network_queries, panoptic_queries, point_queries, source_queries, sparse_queries
from .fixtures import QUERIES, SQL

__all__ = ["graph_queries", "instance_queries", "model_queries", "network_queries", "oracle_sql", "panoptic_queries", "point_queries", "queries", "source_queries", "sparse_queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
