"""Registry of named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
KEPT: set[str] = set()
# Added before rounding on both sides, so that values lying exactly on a rounding border round the same way.
OFF_BORDER = 1.37e-9


def cte(name: str, body: str, once: bool = False) -> None:
    """A named sub-select that oracle statements may use; `once` keeps its rows for all the places that read it."""
    CTES[name] = body
    if once:
        KEPT.add(name)


def expand(sql: str) -> str:
    """Puts the sub-selects a statement uses, directly or not, in front of it, each after those it needs itself."""
    order: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in order and name not in above and re.search(rf"\b{name}\b", text):
                visit(CTES[name], (*above, name))
                order.append(name)

    visit(sql, ())
    return f"WITH RECURSIVE {', '.join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({CTES[n]})" for n in order)} {sql}" if order else sql


def oracles() -> dict[str, str]:
    """Complete statements; assembled once every module has registered its sub-selects."""
    return {name: expand(sql) for name, sql in ORACLES.items()}


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in columns.split()]


def _shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _spec(columns):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double") + F.lit(OFF_BORDER), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def _shape_sql(body: str, columns: str) -> str:
    out = []
    for name, kind in _spec(columns):
        if kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        else:
            c = f"round(CAST({name} AS DOUBLE) + CAST({OFF_BORDER!r} AS DOUBLE), {kind}) + 0.0"
        out.append(f"{c} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({body}) AS q"


def register(name: str, columns: str, sql: str | None = None):
    """Registers a query. `columns` lists name:kind, kind being i, s, b or the decimals kept of a double."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: _shape(fn(spark, sf_dir), columns)
        if sql is not None:
            ORACLES[name] = _shape_sql(sql, columns)
        return fn

    return wrap
