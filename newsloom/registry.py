"""Where operators register the query that shows them and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_held: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL where SQL can say it."""

    def keep(f):
        if name in _held:
            raise ValueError(f"{name} is registered twice")
        _held[name] = Query(name, f, sql)
        return f

    return keep


def registered() -> dict[str, Query]:
    import newsloom.queries  # noqa: F401  registers on import

    return dict(_held)
