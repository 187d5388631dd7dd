"""Exact top-k values of a long-text column without shuffling the texts.

1. Count rows per 96-bit text hash (16-byte keys; partial aggregation).
2. t = the k-th largest count. Values counted above t are fewer than k: their
   strings are fetched by a broadcast semi-join on their hashes (bounded by k).
3. The rest of the top k comes from values counted exactly t, smallest text
   first: when t = 1 those are all values outside step 2, so an anti-join plus
   a distributed ``orderBy().limit()`` (each task keeps only its smallest
   candidates) finds them; when the tie group is small (a proven bound) its
   hashes are broadcast. Otherwise ``None`` is returned and the caller groups
   by the text itself.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import col

TIE_BROADCAST_MAX = 100_000


def _hashed(df: DataFrame, c: str) -> DataFrame:
    x = col(c)
    return df.where(x.isNotNull()).select(F.xxhash64(x).alias("_h1"), F.hash(x).alias("_h2"), x.alias("_x"))


def top_text(df: DataFrame, c: str, k: int) -> list[tuple[str, int]] | None:
    """[(value, count)] of the k most frequent non-null values, ties by value."""
    spark = df.sparkSession
    h = _hashed(df, c)
    counts = h.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("cnt"))
    top_counts = [r["cnt"] for r in counts.select("cnt").orderBy(F.col("cnt").desc()).limit(k).collect()]
    if not top_counts:
        return []
    t = top_counts[-1]
    above = [(r["_h1"], r["_h2"], r["cnt"]) for r in counts.where(F.col("cnt") > t).collect()]   # < k rows
    need = k - len(above)
    out: list[tuple[str, int]] = []
    keys = "_h1 bigint, _h2 int"
    if above:
        ab = F.broadcast(spark.createDataFrame([(a, b) for a, b, _ in above], keys))
        cnt_of = {(a, b): n for a, b, n in above}
        for r in h.join(ab, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2").agg(F.min("_x").alias("v")).collect():
            out.append((r["v"], cnt_of[(r["_h1"], r["_h2"])]))
    if need > 0:
        if t == 1:
            rest = h if not above else h.join(
                F.broadcast(spark.createDataFrame([(a, b) for a, b, _ in above], keys)), ["_h1", "_h2"], "left_anti")
        else:
            ties = counts.where(F.col("cnt") == t)
            if ties.count() > TIE_BROADCAST_MAX:
                return None
            tie_rows = [(r["_h1"], r["_h2"]) for r in ties.select("_h1", "_h2").collect()]
            rest = h.join(F.broadcast(spark.createDataFrame(tie_rows, keys)), ["_h1", "_h2"], "left_semi")
        # copies of one value share its text, so distinct texts = distinct values
        smallest = rest.select("_x").distinct().orderBy("_x").limit(need).collect()
        out += [(r["_x"], t) for r in smallest]
    out.sort(key=lambda vc: (-vc[1], vc[0]))
    return out[:k]


def mean_length(df: DataFrame, columns: list[str]) -> dict[str, float]:
    r = df.agg(*[F.avg(F.length(col(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: (r[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
