"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from workload.sql_tables import with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = with_tables(sql)
        return function

    return register
