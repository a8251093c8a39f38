"""Registered queries, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernweave.queries.registry import ORACLES, QUERIES, Tables

AREAS = ("flows", "scans", "sinks", "shape", "filters", "joins", "sets", "reports", "pages", "semantics", "scalars", "streams")

for _area in AREAS:
    importlib.import_module(f"fernweave.queries.{_area}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
