"""Every registered query of the library, with its DuckDB SQL; modules add theirs on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemora.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views as a query, and its SQL if there is one."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from mnemora.plans import dossiers, entities, feeds, payloads, recalls, relational, retrieval, rules, streams, texts, windows  # noqa: E402, F401
