"""All registered queries of the page-text library, by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.plans import drawn, forms, kept, layout, outlines, pages, sessions, streams, targeting, text

MODULES = [text, pages, forms, sessions, layout, drawn, outlines, targeting, kept, streams]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_markdown(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
