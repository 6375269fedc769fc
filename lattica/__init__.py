"""Lattica: hierarchical point-set analytics expressed as Spark DataFrame jobs."""
