"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of the same result."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import bounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "a2_source_report"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A derived input, stated once in SQL that both engines read alike."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n} ", f"join {{{n}}} ")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


for _module in ("events", "costs", "tasks", "leads", "text", "books", "retrieval", "urls", "risk", "windows", "sources", "routing", "pages", "scans", "intent"):
    if importlib.util.find_spec(f"folioforge.plans.q_{_module}"):
        importlib.import_module(f"folioforge.plans.q_{_module}")
