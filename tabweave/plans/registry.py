"""All registered queries of the library, by name, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "e01_kl_discrete"

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: register a query, and its SQL twin where there is one."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import catalog  # noqa: F401  (registers)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog  # noqa: F401

    return dict(_ORACLES)
