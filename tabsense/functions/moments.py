"""Per-column moments (count, nulls, mean, deviations, skewness, min, max).

Narrow frames: one global aggregate with a few expressions per column.
Wide frames: the long form — each row emits (column, value, is-null) entries
and one ``groupBy(column)`` with a fixed set of aggregates computes every
column at once. The aggregate count then no longer grows with the width, so
planning and generated code stay small for 1,000-column tables, while partial
aggregation keeps the shuffle at one row per column per task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import col

WIDE = 32
SCHEMA = ("position int, column string, n bigint, rows bigint, nulls bigint, mean double, "
          "var_pop double, std_pop double, std_samp double, g1 double, min double, max double")
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


ALL = ("n", "rows", "nulls", "mean", "var_pop", "std_pop", "std_samp", "g1", "min", "max")


def _aggs(v, z, want=ALL):
    """Only the statistics asked for are computed (skewness and the deviations
    carry several buffers each); the others are typed NULL literals."""
    make = {"n": lambda: F.count(v), "rows": lambda: F.count(F.lit(1)), "nulls": lambda: F.count_if(z),
            "mean": lambda: F.avg(v), "var_pop": lambda: F.var_pop(v), "std_pop": lambda: F.stddev_pop(v),
            "std_samp": lambda: F.stddev_samp(v), "g1": lambda: F.skewness(v),
            "min": lambda: F.min(v), "max": lambda: F.max(v)}
    null = {"n": "bigint", "rows": "bigint", "nulls": "bigint"}
    return [(make[k]() if k in want else F.lit(None).cast(null.get(k, "double"))).alias(k) for k in ALL]


def moments_frame(df: DataFrame, columns: list[str] | None = None, wide: int = WIDE,
                  want=ALL) -> DataFrame:
    """One row per column (lazy). Non-numeric columns get only n/rows/nulls."""
    names = list(df.columns)
    columns = names if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], SCHEMA)

    def value(c):
        return col(c).cast("double") if isinstance(df.schema[c].dataType, _NUMERIC) else F.lit(None).cast("double")

    if len(columns) <= wide:
        wide_row = df.agg(*[F.struct(*_aggs(value(c), col(c).isNull(), want)).alias(f"m{i}")
                            for i, c in enumerate(columns)])
        return wide_row.select(F.inline(F.array(*[
            F.struct(F.lit(names.index(c)).alias("position"), F.lit(c).alias("column"), F.col(f"m{i}.*"))
            for i, c in enumerate(columns)])))
    entries = F.array(*[F.struct(F.lit(names.index(c)).alias("p"), value(c).alias("v"),
                                 col(c).isNull().alias("z")) for c in columns])
    long = df.select(F.inline(entries))
    g = long.groupBy("p").agg(*_aggs(F.col("v"), F.col("z"), want))
    name_of = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p") + 1)
    return g.select(F.col("p").cast("int").alias("position"), name_of.alias("column"),
                    *[c for c in g.columns if c != "p"])


def column_moments(df: DataFrame, columns: list[str] | None = None, wide: int = WIDE,
                   want=ALL) -> dict[str, dict]:
    """{column: moments} — one small row per column reaches the driver."""
    return {r["column"]: r.asDict() for r in moments_frame(df, columns, wide, want).collect()}
