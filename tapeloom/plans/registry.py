"""Query registry: Spark callable, output columns and SQL twin side by side.

The column list (``name:kind``) fixes names, order, types and rounding on both
sides: i bigint, f double rounded to 6 digits, s string, b boolean, d date as
yyyyMMdd text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.plans.sql_frames import FRAMES
from tapeloom.sources.tables import Market


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Market], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Market(spark, folder))
        return df.select(*[_spark_column(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(_sql_column(n, k) for n, k in self.columns)
        names = _needed(self.sql)
        prelude = ", ".join(f"{n} as ({FRAMES[n]})" for n in names)
        return f"{'with ' + prelude if prelude else ''} select {picked} from ({self.sql}) as result_rows"


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "f":
        return (F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias(name)
    if kind == "d":
        return F.date_format(c, "yyyyMMdd").alias(name)
    return c.cast({"s": "string", "b": "boolean"}[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"cast({name} as bigint) as {name}"
    if kind == "f":
        return f"floor(cast({name} as double) * 1e6 + 0.5e0) / 1e6 as {name}"
    if kind == "d":
        return f"strftime({name}, '%Y%m%d') as {name}"
    return f"cast({name} as {'varchar' if kind == 's' else 'boolean'}) as {name}"


def _needed(sql: str) -> list[str]:
    """Names of the shared frames a statement uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for name in FRAMES:
            if name in words and name not in order and FRAMES[name] is not text:
                visit(FRAMES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(market) -> DataFrame`` under a name."""
    cols = tuple(tuple(c.split(":")) for c in columns.split())

    def wrap(build: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, cols, build, sql)
        return build

    return wrap
