"""Operators for preparing training text, their queries, and the SQL that checks them."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import tune

# Tasks get the functions of this package by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Module of each registered query.
_QUERIES = {
    "op1_suffix_tree": "suffixtree",
    "op2_jaccard_forest": "forest",
    "op3_decontamination": "tiling",
    "op4_line_dedup": "lines",
    "op5_order_minhash": "orderhash",
    "op6_token_counts": "tokenfiles",
    "op7_toxicity": "toxicity",
    "op8_substring_dedup": "relative",
    "op9_language_id": "language",
    "op10_byte_bpe": "bpe",
    "op11_collocations": "collocations",
    "op12_secret_scan": "secrets",
    "op13_centroid_clustering": "centroids",
}


Query = Callable[[SparkSession, str], DataFrame]


def prepared(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``work`` in a session that splits skewed joins and drops the shuffle files of finished jobs."""

    def run(spark: SparkSession, *args: object) -> DataFrame:
        tune(spark).conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        return work(spark, *args)

    return run


def queries() -> dict[str, Query]:
    return {name: prepared(getattr(importlib.import_module(f"{__name__}.{module}"), name)) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL beside this file, one file per query it can express."""
    folder = Path(__file__).parent / "sql"
    return {name: (folder / f"{name}.sql").read_text() for name in _QUERIES if (folder / f"{name}.sql").exists()}
