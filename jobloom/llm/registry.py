"""Queries of the subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that each hold NAME, query(spark, sf_dir) and SQL (None: tested against brute force).
MODULES = ("license", "url_filter", "warc", "token_files", "chat", "knn", "packing", "quality", "decontaminate", "simhash", "manifest", "mixing", "alignment")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [import_module(f"jobloom.llm.{m}") for m in MODULES]
    return {m.NAME: m.query for m in own} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    own = [import_module(f"jobloom.llm.{m}") for m in MODULES]
    return {m.NAME: m.SQL for m in own if m.SQL}
