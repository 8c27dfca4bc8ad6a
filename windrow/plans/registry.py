"""All queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windrow.plans import near_dup, stored, tables, text_queries, triage

MODULES = (near_dup, text_queries, triage, tables, stored)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in MODULES:
        out |= module.ORACLES
    return out
