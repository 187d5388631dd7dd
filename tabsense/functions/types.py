"""Logical column types and missing-value normalisation.

Four logical types exist: numeric, datetime, boolean, categorical. Nested
columns (array/map/struct) are outside the data model.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
DATETIME = "datetime"
BOOLEAN = "boolean"
CATEGORICAL = "categorical"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


class NestedColumnError(TypeError):
    """Raised for array/map/struct columns, which the data model excludes."""


def logical_type(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, _NUMERIC):
        return NUMERIC
    if isinstance(dt, _DATETIME):
        return DATETIME
    return CATEGORICAL


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, _NESTED)


def logical_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if logical_type(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def flat(df: DataFrame, exclude_nested: bool = False) -> DataFrame:
    """Reject (or drop, when ``exclude_nested``) nested columns."""
    nested = [f.name for f in df.schema.fields if is_nested(f.dataType)]
    if not nested:
        return df
    if exclude_nested:
        return df.drop(*nested)
    raise NestedColumnError(
        f"nested columns are not supported: {nested}; pass exclude_nested=True to skip them")


def normalize_missing(df: DataFrame, exclude_nested: bool = False, exact: bool = False) -> DataFrame:
    """NaN -> NULL for float columns, decimal -> double, nested rejected.

    pandas has one missing-value concept; Spark keeps NaN and NULL apart, and
    NaN poisons avg/percentile. Done once, as a pure projection. ``exact`` keeps
    decimals as they are, for whatever asks which values are equal: doubles tell long
    decimal keys apart only up to 2**53."""
    df = flat(df, exclude_nested)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType) and not exact:
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def col(name: str) -> Column:
    """Column reference safe for any name (spaces, dots, symbols)."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_key(df: DataFrame, name: str) -> Column:
    """Type-preserving string key of a value, for frequency tables.

    -0.0 and 0.0 are one value (as in pandas); distinct doubles print to
    distinct strings (shortest round-trip form)."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
    return c.cast("string")
