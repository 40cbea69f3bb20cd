"""Registry of queries: a Spark plan, its result columns, and an independent SQL statement.

The result columns are declared once, as ``name:type``. Types: ``l`` long, ``i`` int, ``s``
string, ``b`` boolean, ``date``, ``ts``, ``dN`` double rounded to N digits. Both sides are cast and
rounded by that declaration, so a comparison sees values, not number formats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import CTES, Tables

SPARK_TYPES = {"l": "bigint", "i": "int", "s": "string", "b": "boolean", "date": "date", "ts": "timestamp_ntz"}
SQL_TYPES = {"l": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "b": "BOOLEAN", "date": "DATE", "ts": "TIMESTAMP"}


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder)).select(*[_spark(n, t) for n, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return f"SELECT {', '.join(_sql(n, t) for n, t in self.columns)} FROM ({self.sql}) AS q"


def _spark(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind[0] == "d" and kind[1:].isdigit():
        return F.round(c.cast("double"), int(kind[1:])).alias(name)
    return c.cast(SPARK_TYPES[kind]).alias(name)


def _sql(name: str, kind: str) -> str:
    if kind[0] == "d" and kind[1:].isdigit():
        # As Spark does: the shortest decimal that names the double, rounded half up.
        x = f'CAST("{name}" AS DOUBLE)'
        return f'CASE WHEN abs({x}) < 1e20 THEN CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 16)), {kind[1:]}) AS DOUBLE) ELSE {x} END AS "{name}"'
    return f'CAST("{name}" AS {SQL_TYPES[kind]}) AS "{name}"'


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, columns: str, sql: str | None = None):
    """Register a plan under a name. ``covers`` lists the inventory ids it shows."""
    cols = tuple(tuple(c.split(":")) for c in columns.split())

    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), cols, build, sql)
        return build

    return wrap


def ctes(names: str, body: str, **extra: str) -> str:
    """SQL with the named shared tables (and those they need) in front of ``body``."""
    order: list[str] = []

    def need(n):
        deps, _ = CTES[n]
        for d in deps.split():
            need(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}"
