"""The queries of this subpackage: each reads its whole table from `sf_dir`."""

from __future__ import annotations

import importlib

from . import sql

#: name -> (module, function of the tables, tables)
_QUERIES = {
    "op1_quality_rules": ("quality", "quality_report", ("documents",)),
    "op2_best_fit_packing": ("packing", "packing_report", ("documents",)),
    "op3_language_id": ("langid", "language_report", ("documents",)),
    "op4_substring_dedup": ("rlz", "substring_dedup_report", ("documents",)),
    "op5_toxicity": ("toxicity", "toxicity_report", ("documents", "labels")),
    "op6_decontamination": ("decontam", "decontamination_report", ("documents", "benchmark")),
    "op7_line_dedup": ("linededup", "line_dedup_report", ("documents",)),
    "op8_suffix_array_dedup": ("repeats", "repeat_removal_report", ("documents",)),
    "op9_minhash_near_dedup": ("neardup", "near_duplicate_report", ("documents",)),
    "op10_license_scan": ("licenses", "scan_licences", ("documents",)),
    "op11_simhash_near_dedup": ("simhash", "simhash_report", ("documents",)),
    "op12_spelling_variants": ("spelling", "spelling_report", ("documents",)),
    "op13_conversation_repair": ("conversations", "conversation_repair_report", ("conversations",)),
}


def _query(module: str, function: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        f = getattr(importlib.import_module(f"{__package__}.{module}"), function)
        return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return run


def queries() -> dict:
    return {name: _query(*x) for name, x in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in _QUERIES}
