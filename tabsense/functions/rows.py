"""Content hashes of whole rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import col


def row_hash(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two independent 64-bit content hashes of a row (of ``columns``); -0.0 is
    hashed as 0.0 (they group together). Of n distinct rows, n*n/2**129 pairs are
    expected to agree in both."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    parts = []
    for f in fields:
        x = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            x = F.when(x == 0, F.lit(0.0).cast(f.dataType)).otherwise(x)
        parts.append(x)
    # null-position bitmasks (62 columns per long) keep (NULL, 1) and (1, NULL)
    # apart: xxhash64 itself skips NULL inputs
    names = [f.name for f in fields]
    masks = []
    for start in range(0, len(names), 62):
        m = F.lit(0).cast("bigint")
        for i, n in enumerate(names[start:start + 62]):
            m = m + F.when(col(n).isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        masks.append(m)
    return [F.xxhash64(*parts, *masks), F.xxhash64(F.lit("second"), *parts, *masks)]
