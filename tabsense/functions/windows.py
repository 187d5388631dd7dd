"""Ordered computations without a global single-task window.

``with_buckets`` cuts rows into range buckets of an order key (quantile cut
points; a hot key value is split by a row hash) so that prefix computations
(running totals, forward fill) run per bucket in parallel, with a carry-in
computed over the small per-bucket summary.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from .types import col


def with_buckets(df: DataFrame, key: Column, tb: Column, cuts: list[float]) -> DataFrame:
    """Add ``_b``: a bucket id monotone in (key, tiebreak).

    ``cuts`` are sorted quantile cut points of the key (with repeats). The
    interval index comes from ``Bucketizer`` (binary search on the JVM). A key
    value repeated m >= 2 times among the cut points holds about m/n of the
    rows; its rows are split into m buckets by ranges of the 64-bit tiebreak
    hash, so even one key holding a third of all rows spreads over many tasks."""
    from pyspark.ml.feature import Bucketizer

    uniq: list[list] = []
    for b in cuts:
        if not uniq or uniq[-1][0] != b:
            uniq.append([b, 1])
        else:
            uniq[-1][1] += 1
    # layout: bucket 0 = key < u_1; per cut point j: (m_j buckets for key == u_j if hot), then one
    # bucket for the rest of [u_j, u_j+1)
    base_eq, base_gt, nxt = [0], [0], 1
    for _, m in uniq:
        base_eq.append(nxt if m >= 2 else -1)
        nxt += m if m >= 2 else 0
        base_gt.append(nxt)
        nxt += 1
    splits = [float("-inf")] + [u for u, _ in uniq] + [float("inf")]
    d = df.withColumn("_k", key).withColumn("_tb", tb)
    d = Bucketizer(splits=splits, inputCol="_k", outputCol="_i", handleInvalid="keep").transform(
        d.withColumn("_k", F.coalesce(F.col("_k"), F.lit(float("nan")))))
    idx = F.col("_i").cast("int")
    arr = lambda xs, t: F.array(*[F.lit(x).cast(t) for x in xs])
    cut_at = F.element_at(arr([0.0] + [u for u, _ in uniq], "double"), idx + 1)
    m_at = F.element_at(arr([0] + [m for _, m in uniq], "int"), idx + 1)
    sub = F.least(F.floor((F.col("_tb").cast("double") + 2.0 ** 63) / (F.lit(2.0 ** 64) / m_at)),
                  m_at - 1).cast("int")
    b = (F.when(F.isnan("_k") | (idx > len(uniq)), F.lit(nxt))
         .when((idx > 0) & (m_at >= 2) & (F.col("_k") == cut_at),
               F.element_at(arr(base_eq, "int"), idx + 1) + sub)
         .otherwise(F.element_at(arr(base_gt, "int"), idx + 1)))
    return d.withColumn("_b", b.cast("int")).drop("_k", "_i")


def numeric_key(df: DataFrame, name: str) -> Column | None:
    """Order-preserving double of a numeric / date / timestamp key (no time zone
    involved), used only to cut the key range into buckets."""
    dt = df.schema[name].dataType
    x = col(name)
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)").cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(x).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                       T.DoubleType, T.DecimalType)):
        return x.cast("double")
    return None


def in_ranges(df: DataFrame, order: list[Column], out: str = "_b") -> DataFrame:
    """Rows dealt to ranges of the whole order key (any type), ``out`` being the
    range's number. Which row went where is decided by sampling, so the result is
    a checkpointed table: every later read sees the same ranges."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()))


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds the row number (from 1) in ``order``: local row numbers per range plus
    the rows of the ranges before (one row per range)."""
    d = in_ranges(df, order)
    before = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return d.join(F.broadcast(before), "_b").withColumn(out, F.col("_before") + local) \
        .drop("_b", "_before")


def cut_points(df: DataFrame, key: Column, n: int) -> list[float]:
    """n-quantile cut points of a numeric key (sketch; they only place buckets)."""
    probs = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, F.array(*[F.lit(p) for p in probs]), 10000)
                 .alias("b")).first()["b"]
    return sorted(float(b) for b in (got or []) if b is not None)


def running_sum(df: DataFrame, value: str, order: str, partition: list[str] | None = None,
                out: str = "cumulative", buckets: int | None = None) -> DataFrame:
    """Running total of ``value`` in ``order`` order (ties: all rows of the
    same order value are summed together, as a RANGE frame), per ``partition``.

    Rows are cut into order-key range buckets; per (partition, bucket) totals
    give the carry-in (a table of partitions x buckets rows); the running sum
    inside a bucket is a window over (partition, bucket)."""
    partition = list(partition or [])
    key = numeric_key(df, order)
    w_local = (Window.partitionBy(*[col(p) for p in partition], "_b").orderBy(col(order))
               .rangeBetween(Window.unboundedPreceding, 0))
    if key is None:   # text and other order keys: ranges of the key itself (ties stay together)
        d = in_ranges(df, [col(order).asc()])
    else:
        n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)
        # ties must stay in one bucket for a RANGE frame: split only by key, never by hash
        d = with_buckets(df, key, F.lit(0).cast("long"), sorted(set(cut_points(df, key, n))))
    tot = d.groupBy(*[col(p) for p in partition], "_b").agg(F.sum(col(value)).alias("_t"))
    wc = Window.partitionBy(*[col(p) for p in partition]).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = tot.select(*[col(p) for p in partition], "_b",
                       F.coalesce(F.sum("_t").over(wc), F.lit(0)).alias("_carry"))
    carry = carry.select(*[col(p).alias(f"_k{i}") for i, p in enumerate(partition)],
                         F.col("_b").alias("_cb"), "_carry")
    cond = [F.col("_b") == F.col("_cb")] + [col(p).eqNullSafe(F.col(f"_k{i}"))
                                            for i, p in enumerate(partition)]
    j = d.join(carry, cond, "left")
    return j.select(*[col(c) for c in df.columns],
                    (F.sum(col(value)).over(w_local) + F.col("_carry")).alias(out))
