"""Table access helpers: load parquet tables, previews."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import col, normalize_missing


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A flat table with one kind of missing value (NaN becomes NULL); decimals stay."""
    return normalize_missing(spark.read.format(fmt).load(path), exact=True)


def preview(df: DataFrame, n: int = 50, order_by: list[str] | str | None = None,
            descending: bool = False, as_json: bool = False) -> DataFrame:
    """The first ``n`` rows under an explicit order (a top-n report).

    Spark plans ``orderBy().limit()`` as TakeOrderedAndProject: each task keeps
    only its own top n, so no full sort or shuffle of the data happens. Without
    an order key the rows are arbitrary (Spark frames have no row order), so
    all columns are used as the key to make the result reproducible."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by or df.columns)
    ordering = [col(k).desc() if descending else col(k).asc() for k in keys]
    # remaining columns break ties deterministically
    ordering += [col(c).asc() for c in df.columns if c not in keys]
    out = df.orderBy(*ordering).limit(n)
    if as_json:
        out = out.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("record"))
    return out
