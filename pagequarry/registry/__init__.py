"""Every registered query with the SQL that checks it.

Each module here adds entries with ``@query(name, sql=..., survey=...)``. A
query takes the test tables (``Tables``) and returns a DataFrame. Queries
without SQL are checked in ``tests/`` against brute force on small inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..mappings import Tables, with_views


@dataclass
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    survey: str


QUERIES: dict[str, Query] = {}


def query(name: str, survey: str, views: str = "", sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, with_views(views, sql) if sql else None, survey)
        return fn

    return add


def load() -> dict[str, Query]:
    import importlib

    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES


MODULES = ["catalog", "grid", "light", "scalars", "jobs", "evaluation", "changes", "upkeep"]
