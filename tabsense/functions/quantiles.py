"""Exact linear-interpolated quantiles with bounded memory.

``percentile`` is exact but, as a global aggregate, ships one value -> count
map per input partition to a single final task. ``exact_quantiles`` selects the
wanted order statistics by radix instead (``radix``): at most six passes over the
columns, whatever their values, each of which sends at most 4,096 counts per task and
bracket. No sketch, no retry, no gathering of values; a value holding a third of the
rows is one count. The same plan serves every size and width.

``grouped_quantiles`` does the same per group while the groups fit a broadcast of
checked size; beyond that, groups are many and a running count over their distinct
values is cheaper than bins.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import agg_row, keep
from .radix import select_columns, select_groups
from .types import col

ACCURACY = 10_000     # of the sketch that method="approx" reads
BINS = 4096
GROUPS = 10_000          # most groups, and
GROUP_BYTES = 16 << 20   # most bytes of their keys, that are broadcast


def exact_quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float],
                    method: str = "auto", bins: int = BINS) -> dict[str, list]:
    """{name: [quantile per prob]} (None for a column without values). NaN counts
    as missing. ``method="approx"`` reads one sketch instead."""
    names = list(exprs)
    if not names:
        return {}
    xs = {k: F.nanvl(exprs[k].cast("double"), F.lit(None).cast("double")) for k in names}
    if method == "approx":
        arr = F.array(*[F.lit(float(p)) for p in probs])
        r = agg_row(df, [F.percentile_approx(xs[k], arr, ACCURACY).alias(f"q{i}")
                         for i, k in enumerate(names)])
        return {k: _floats(r[f"q{i}"], len(probs)) for i, k in enumerate(names)}
    got, _ = select_columns(df, [xs[k] for k in names], [float(p) for p in probs],
                            max(1, int(math.log2(bins))))
    return {k: v or [None] * len(probs) for k, v in zip(names, got, strict=True)}


def _floats(v, n):
    return [None] * n if v is None else [None if x is None else float(x) for x in v]


def value_counts(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """(groups, _v, _c): how often each non-missing value occurs per group. Copies
    of a hot value collapse map-side; the table is kept, as several steps read it."""
    value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return keep(df.where(value.isNotNull()).groupBy(*[col(c) for c in groups], value.alias("_v"))
                .agg(F.count(F.lit(1)).alias("_c")))


def few_groups(df: DataFrame, groups: list[str]) -> DataFrame | None:
    """The distinct groups with numbers from 0 (column ``series``), or None if they are
    too many or too wide to broadcast."""
    met = keep(df.select(*[col(c) for c in groups]).distinct())
    width = sum((F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) + 8 for c in groups), F.lit(0))
    size = met.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    if size["n"] > GROUPS or (size["bytes"] or 0) > GROUP_BYTES:
        return None
    # at most GROUPS rows: numbered in one task
    return keep(met.withColumn("series", (F.row_number().over(Window.orderBy(*[col(c) for c in groups])) - 1)
                               .cast("int")))


def numbered(df: DataFrame, groups: list[str], value: Column, met: DataFrame) -> DataFrame:
    """Rows (series, v) by broadcasting the numbers of ``few_groups``; null-safe."""
    other = met.select(*[col(c).alias(f"_r{i}") for i, c in enumerate(groups)], "series")
    on = [col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(groups)]
    return df.select(*[col(c) for c in groups], value.cast("double").alias("v")) \
        .join(F.broadcast(other), on).select("series", "v")


def grouped_quantiles(df: DataFrame, groups: list[str], value: Column, probs: list[float],
                      names: list[str] | None = None, met: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group with values (group
    columns, one column per prob, and ``n``). ``met``: the groups, if already known."""
    names = names or [f"q{i}" for i in range(len(probs))]
    if met is None and groups:
        met = few_groups(df, groups)
    if met is None:
        return quantiles_of_counts(value_counts(df, groups, value), groups, probs, names)
    found, _ = select_groups(numbered(df, groups, value, met), met.count(), [float(p) for p in probs])
    rows = [(i, *q, n) for i, (n, q) in found.items()]
    of = df.sparkSession.createDataFrame(
        rows, "series int, " + "".join(f"_q{k} double, " for k in range(len(probs))) + "n long")
    return met.join(F.broadcast(of), "series").select(
        *[col(c) for c in groups], *[F.col(f"_q{k}").alias(x) for k, x in enumerate(names)], "n")


def quantiles_of_counts(vc: DataFrame, groups: list[str], probs: list[float],
                        names: list[str] | None = None) -> DataFrame:
    """The same from ``value_counts``: a running count over values per group is
    computed per value-range bucket (``running_sum``; a group with many distinct
    values spreads over many tasks), then only the rows whose count range covers a
    wanted rank are kept and combined per group."""
    from .windows import running_sum

    names = names or [f"q{i}" for i in range(len(probs))]
    g = [col(c) for c in groups]
    n = vc.groupBy(*g).agg(F.sum("_c").alias("_n"))
    cum = running_sum(vc, "_c", "_v", groups or None, out="_cum")
    if groups:
        # null-safe: the NULL group has quantiles like any other
        other = n.select(*[col(c).alias(f"_r{i}") for i, c in enumerate(groups)], "_n")
        j = cum.join(other, [col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(groups)],
                     "left").drop(*[f"_r{i}" for i in range(len(groups))])
    else:
        total = n.first()
        j = cum.withColumn("_n", F.lit(total["_n"] if total else 0))
    ranks, outs = [], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        k0 = F.floor(h)
        k1 = F.least(k0 + 1, F.col("_n") - 1)
        lo = F.col("_cum") - F.col("_c")                 # rank of the first copy of this value
        covers = lambda k: (lo <= k) & (k < F.col("_cum"))
        ranks += [F.when(covers(k0), F.col("_v")).alias(f"_a{i}"), F.when(covers(k1), F.col("_v")).alias(f"_b{i}"),
                  (h - k0).alias(f"_f{i}")]
    picked = j.select(*g, "_n", *ranks)
    keep_row = None
    for i in range(len(probs)):
        c = F.col(f"_a{i}").isNotNull() | F.col(f"_b{i}").isNotNull()
        keep_row = c if keep_row is None else (keep_row | c)
    agg = picked.where(keep_row).groupBy(*g).agg(
        F.max("_n").alias("n"),
        *[x for i in range(len(probs)) for x in (F.min(f"_a{i}").alias(f"_a{i}"), F.min(f"_b{i}").alias(f"_b{i}"),
                                                 F.max(f"_f{i}").alias(f"_f{i}"))])
    return agg.select(*g, *[(F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(names[i])
                            for i in range(len(probs))], "n")
