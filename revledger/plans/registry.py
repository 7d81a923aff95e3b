"""Query registry: name -> (Spark builder over fixtures, DuckDB oracle SQL).

Builders take a :class:`Fixtures` and return a DataFrame. Oracle SQL names
tables and fixture views as ``{name}``; :func:`oracle` expands the views
it uses into CTEs.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from revledger.plans.fixtures import Fixtures, duckdb_sql


@dataclass
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    uses: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, uses, sql)
        return fn
    return deco


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    return None if q.sql is None else duckdb_sql(q.sql, q.uses)
