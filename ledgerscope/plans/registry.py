"""Registered queries: a Spark callable per name and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.plans.sql import with_views
from ledgerscope.plans.pipeline import Pipeline

BUILDS: dict[str, Callable[[Pipeline], DataFrame]] = {}
SQLS: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Pipeline], DataFrame], views: str = "", sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    BUILDS[name] = build
    QUERIES[name] = lambda spark, folder: build(Pipeline(spark, folder))
    if sql is not None:
        SQLS[name] = views, sql
        ORACLES[name] = with_views(views, sql)
