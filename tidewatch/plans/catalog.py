"""All registered queries of the surveillance library, with their SQL.

Names begin with the operator's number in the survey. SQL is left out where it can't express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "t1_top_wallets"
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name."""

    def register(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries named {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return register


def _load() -> None:
    from . import detection, frames, grading, integrity, normalizing, reporting, scalars, trading, watching  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
