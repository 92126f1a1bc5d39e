"""All core queries by name, each with the SQL that checks it.

A query is a function of `Tables`; the decorator files it under the id of the operator it shows. `sql` is the same
question for another engine; without it the query is checked by tests only.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forumlens.sources.catalog import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("scans", "predicates", "joins", "aggregates", "ordering", "scalars", "texts", "nested", "vector_queries", "geo", "content", "languages", "keywords", "clusters", "labels", "recommendations", "targeting", "streams")


class Tables:
    """The tables of one data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Files a function of `Tables` as the query `name`."""

    def file(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return file


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"forumlens.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
