"""Registered queries: one Spark plan and one DuckDB oracle per operator key.

Each entry reads whole driver tables (or an injected variant of a whole table)
and applies one library operator. Floating results are rounded to 6 decimals in
both engines so that summation order cannot flip the comparison.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .variants import VARIANTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def with_(*names: str) -> str:
    """WITH clause for the variants used (a no-op CTE for plain tables)."""
    vs = [n for n in names if n in VARIANTS]
    if not vs:
        return "WITH _none AS (SELECT 1 AS x) "
    return "WITH " + ", ".join(f"{n} AS ({VARIANTS[n]})" for n in vs) + " "


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def r6sql(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


# import the registration modules (they populate QUERIES / ORACLE)
from . import q_profile, q_clean, q_features, q_charts, q_query, q_ml, q_report  # noqa: E402,F401
