"""Every query over the sample tables, with the SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import configure

SECTIONS = (
    "rollup_queries", "quality_queries", "semantic_queries", "event_queries", "history_queries", "settlement_queries",
    "streaming_queries",
)

Query = Callable[[SparkSession, str], DataFrame]


def _with_settings(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for section in SECTIONS:
        for name, query in import_module(f"{__name__}.{section}").QUERIES.items():
            found[name] = _with_settings(query)
    return found


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for section in SECTIONS:
        found.update(import_module(f"{__name__}.{section}").ORACLE)
    return found
