"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline import fixed
from seamline.session import tuned
from seamline.workloads.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(c: Column, digits: int) -> Column:
    """Half up, in plain double arithmetic that keeps the generated code small.

    A value too large to have such digits stays as it is, and so do NaN and
    infinities, which no comparison below holds for.
    """
    scale = 10.0**digits
    return F.when(F.abs(c) < 2.0**53 / scale, F.floor(c * scale + 0.5) / F.lit(scale)).otherwise(c)


def canonical(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Output form of every query: rounded doubles, 64-bit integers."""
    out = []
    per_column = digits if isinstance(digits, dict) else {}
    common = 6 if per_column else digits
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = _rounded(c.cast("double"), per_column.get(field.name, common))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def _with_views(sql: str) -> str:
    """Prepend the stand-in views that a query mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    sql = sql.strip().replace("{BLANK}", fixed.BLANK)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed).replace("{BLANK}", fixed.BLANK)
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


def query(name: str, oracle: str | None = None, digits: int | dict[str, int] = 6):
    """Register a query; ``oracle`` is the equivalent SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: canonical(fn(tuned(spark), sf), digits)
        if oracle is not None:
            ORACLES[name] = _with_views(oracle)
        return fn

    return register
