"""The text queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = ("op1_decontamination", "op2_tokens", "op3_license", "op4_html", "op5_lm", "op6_packing", "op7_merkle", "op8_jaccard", "op9_suffix", "op10_quality", "op11_divergence", "op12_centroids", "op13_bytepair")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script at the top of the repository, which a package shipped alone doesn't have."""
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(import_module(f"{__package__}.{n}"), n) for n in NAMES} | {"pipeline": pipeline}


def oracles() -> dict[str, str]:
    found = {n: getattr(import_module(f"{__package__}.{n}"), "ORACLE_SQL", None) for n in NAMES}
    return {n: sql for n, sql in found.items() if sql}
