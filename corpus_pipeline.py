"""A corpus pipeline over `documents`: quality rules, line dedup, near dedup, decontamination, packing."""

from __future__ import annotations

from lattica.llm import decontam, linededup, neardup, packing, quality
from lattica.llm.common import dropped, written


def quality_rules(spark, docs, sf_dir):
    """Keeps the documents that pass every quality rule."""
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Takes repeated three-line windows out of the texts."""
    return linededup.dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs, k=5, percent=80)


def decontaminate(spark, docs, sf_dir):
    """Drops the documents that hold a passage of the benchmark."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Packs the texts into sequences of 4096 tokens; one row per piece."""
    return packing.packed_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
