"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.plans import extraction, pages, records, sources, streams, workflow

MODULES = [pages, workflow, records, sources, extraction, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extraction_plan(spark, sf_dir)
