"""Every query of the price-panel library by name, with the SQL that DuckDB checks it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.plans import calibration_queries, list_queries, panel_queries, scan_queries, score_queries

MODULES: tuple = (panel_queries, score_queries, scan_queries, list_queries, calibration_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
