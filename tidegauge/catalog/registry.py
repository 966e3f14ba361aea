"""Registry of named queries with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.catalog.views import SQL_VIEWS, Views
from tidegauge.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the SQL with the view definitions it names, in dependency order."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name in text and name not in used:
                visit(body)
                if name not in used:
                    used.append(name)

    visit(sql)
    heads = [f"{name} AS ({SQL_VIEWS[name]})" for name in used]
    body = sql.strip()
    if not heads:
        return body
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(heads) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(heads) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a function of ``Views`` under a query name."""

    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(configure(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
