"""Chart-ready tables (H1-H13): the aggregated table behind each chart type.

``resolve_chart`` applies the chart-type fallbacks from the schema alone;
``chart_data`` returns a DataFrame. Every table is an aggregate over the whole
input (partial aggregation map-side), never a row sample, unless a scatter
bound is asked for explicitly.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import NUMERIC, col, logical_types, normalize_missing
from ..functions.quantiles import (exact_quantiles, few_groups, grouped_quantiles,
                                   quantiles_of_counts, value_counts)
from ..config import cut_lineage
from ..functions.windows import global_rank, running_sum

BINS = 20              # fixed values: histogram/violin bins, IQR whisker factor
WHISKER = 1.5
CHART_TYPES = ("bar", "histogram", "line", "scatter", "box", "violin", "pie", "area",
               "treemap", "funnel", "sunburst", "heatmap", "scatter_3d", "line_3d",
               "surface_3d", "bar_3d")


@dataclass
class ChartSpec:
    chart_type: str
    x: str | None = None
    y: str | list[str] | None = None
    color: str | None = None
    z: str | None = None
    path: list[str] = field(default_factory=list)
    agg: str = "sum"


@dataclass(frozen=True)
class Needs:
    """What a chart type plots: whether a value column is looked for when none is named,
    and what stands in where there is none: ``wide`` takes all other numeric columns,
    ``then`` is the type drawn when that fails too."""
    value: bool = True
    wide: bool = False
    then: str | None = None


# every type not listed plots a value if there is one and needs no stand-in
NEEDS = {"histogram": Needs(value=False), "bar": Needs(then="histogram"),
         "line": Needs(wide=True, then="histogram"), "area": Needs(wide=True, then="histogram")}


def resolve_chart(df: DataFrame, chart_type: str | None, x: str | None = None,
                  y: str | None = None, color: str | None = None, z: str | None = None,
                  path: list[str] | None = None) -> ChartSpec:
    """What to draw, from the schema alone: ``NEEDS`` says what each type wants. Names
    that are no columns count as not given, but a wrong y is not replaced; x falls back
    to the first column. A type that is none becomes a bar of the first column by the
    first other numeric one, or its histogram."""
    kinds = logical_types(df)
    first, *others = df.columns

    def known(name: str | None) -> str | None:
        return name if name in kinds else None

    def numeric_but(name: str) -> list[str]:
        return [c for c, kind in kinds.items() if kind == NUMERIC and c != name]

    asked = (chart_type or "").lower()
    if asked not in CHART_TYPES:
        value = next(iter(numeric_but(first)), None)
        return ChartSpec("bar" if value else "histogram", first, value)
    needs = NEEDS.get(asked, Needs())
    spec = ChartSpec(asked, known(x) or first, known(y), known(color), known(z),
                     [p for p in path or () if p in kinds])
    if y is None and needs.value:
        spec.y = next(iter(others), None)
    if spec.y is None and needs.wide and (values := numeric_but(spec.x)):
        return ChartSpec(asked, spec.x, values, spec.color)
    if spec.y is None and needs.then:
        spec.chart_type = needs.then
    return spec


def chart_data(df: DataFrame, spec: ChartSpec, bins: int = BINS) -> DataFrame:
    df = normalize_missing(df)
    t = spec.chart_type
    if t == "histogram":
        return histogram(df, spec.x, spec.y, spec.color, bins)
    if t == "bar":
        return bar(df, spec.x, spec.y, spec.color, spec.agg)
    if t == "line":
        if isinstance(spec.y, list):
            return wide_form(df, spec.x, spec.y)
        return line(df, spec.x, spec.y, spec.color, spec.agg)
    if t == "area":
        if isinstance(spec.y, list):
            return wide_form(df, spec.x, spec.y, cumulative=True)
        return area(df, spec.x, spec.y, spec.color)
    if t == "scatter":
        return scatter(df, spec.x, spec.y, spec.color)
    if t == "box":
        return box(df, spec.y or spec.x, spec.x if spec.y else None)
    if t == "violin":
        return violin(df, spec.y or spec.x, spec.x if spec.y else None, bins)
    if t == "pie":
        return pie(df, spec.x, spec.y)
    if t == "treemap":
        return treemap(df, [spec.x] + [p for p in spec.path if p != spec.x], spec.y)
    if t == "funnel":
        return funnel(df, spec.x, spec.y)
    if t == "sunburst":
        return sunburst(df, spec.path or [spec.x, spec.color or spec.y], spec.z)
    if t == "heatmap":
        return heatmap(df, spec.x, spec.y, spec.z)
    if t in ("scatter_3d", "line_3d"):
        return xyz(df, spec.x, spec.y, spec.z, spec.color)
    if t == "surface_3d":
        return surface(df, spec.x, spec.y, spec.z)
    if t == "bar_3d":
        return bar_3d(df, spec.x, spec.y, spec.z)
    raise ValueError(f"unknown chart type {t}")


def _groups(*names: str | None) -> list[Column]:
    return [col(n) for n in names if n]


def _agg(y: str | None, how: str = "sum") -> Column:
    if y is None:
        return F.count(F.lit(1))
    return {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max,
            "count": F.count}[how](col(y))


# H1 ---------------------------------------------------------------------------
def histogram(df: DataFrame, x: str, y: str | None = None, color: str | None = None,
              bins: int = BINS) -> DataFrame:
    """Numeric x: ``bins`` equal-width bins over [min, max] (max in the last bin;
    one bin when min = max); text x: one row per value. Value = count, or
    sum(y) when y is given."""
    kinds = logical_types(df)
    val = (F.count(F.lit(1)) if y is None else F.sum(col(y))).alias("count" if y is None else f"sum_{y}")
    if kinds[x] != NUMERIC:
        return df.groupBy(*_groups(x, color)).agg(val)
    b = df.agg(F.min(col(x)).cast("double").alias("lo"), F.max(col(x)).cast("double").alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], f"bin int, bin_start double, bin_end double, {'count bigint' if y is None else f'sum_{y} double'}")
    width = (hi - lo) / bins
    xb = F.when(col(x).isNull(), F.lit(None)).otherwise(
        F.lit(0) if width == 0 else
        F.least(F.floor((col(x).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    g = df.where(col(x).isNotNull()).groupBy(xb.alias("bin"), *_groups(color)).agg(val)
    return g.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(
                        F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                    *[c for c in g.columns if c not in ("bin",)])


# H2 / H7 ----------------------------------------------------------------------
def box(df: DataFrame, y: str, group: str | None = None) -> DataFrame:
    """q1, median, q3 (linear), whiskers (furthest values within 1.5 IQR of the
    box), outlier count and n, per group. Quartiles are selected by radix and joined to
    the rows by broadcast; only groups too many for that meet as value counts."""
    groups = [group] if group else []
    names, probs = ["q1", "median", "q3"], [0.25, 0.5, 0.75]
    met = few_groups(df, groups) if group else None
    if group and met is None:
        rows = value_counts(df, groups, col(y))
        qs = quantiles_of_counts(rows, groups, probs, names)
    else:
        value = F.nanvl(col(y).cast("double"), F.lit(None).cast("double"))
        rows = df.select(*_groups(group), value.alias("_v"), F.lit(1).alias("_c")).where("_v is not null")
        if group:
            qs = F.broadcast(grouped_quantiles(df, groups, col(y), probs, names, met))
        else:
            got = exact_quantiles(df, {"y": col(y)}, probs)["y"]
            j = rows.select("*", *[F.lit(q).cast("double").alias(n) for n, q in zip(names, got)])
    if group:
        # null-safe: the NULL group has a box like any other
        other = qs.drop("n").withColumnRenamed(group, "_group")
        j = rows.join(other, col(group).eqNullSafe(F.col("_group"))).drop("_group")
    lo = F.col("q1") - WHISKER * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + WHISKER * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    return j.groupBy(*_groups(group), "q1", "median", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("lower_whisker"),
        F.max(F.when(v <= hi, v)).alias("upper_whisker"),
        F.sum(F.when((v < lo) | (v > hi), F.col("_c")).otherwise(0)).alias("n_outliers"),
        F.sum("_c").alias("n"))


def _attach(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row frame's columns to every row as literals (the row is
    fetched once; no join)."""
    r = one_row.first()
    if r is None:
        return big.select("*", *[F.lit(None).alias(c) for c in one_row.columns])
    return big.select("*", *[F.lit(r[c]).alias(c) for c in one_row.columns])


def violin(df: DataFrame, y: str, group: str | None = None, bins: int = BINS) -> DataFrame:
    """Per group: box statistics and a binned density cnt / (n * width) over
    ``bins`` equal-width bins of the whole column's range."""
    b = df.agg(F.min(col(y)).cast("double").alias("lo"), F.max(col(y)).cast("double").alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    width = ((hi - lo) / bins) if lo is not None else 0.0
    xb = (F.lit(0) if not width else
          F.least(F.floor((col(y).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    g = _groups(group)
    cnt = df.where(col(y).isNotNull()).groupBy(*g, xb.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    stats = box(df, y, group)
    if group:
        other = stats.withColumnRenamed(group, "_group")
        j = cnt.join(other, col(group).eqNullSafe(F.col("_group"))).drop("_group")
    else:
        j = _attach(cnt, stats)
    dens = F.col("cnt") / (F.col("n") * F.lit(width if width else 1.0))
    return j.select(*g, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"), "cnt",
                    dens.alias("density"), "q1", "median", "q3", "lower_whisker", "upper_whisker")


# H3-H5, H11 -------------------------------------------------------------------
def bar(df: DataFrame, x: str, y: str | None, color: str | None = None, how: str = "sum") -> DataFrame:
    name = f"{how}_{y}" if y else "count"
    return df.groupBy(*_groups(x, color)).agg(_agg(y, how).alias(name))


def line(df: DataFrame, x: str, y: str | None, color: str | None = None, how: str = "sum") -> DataFrame:
    return bar(df, x, y, color, how).orderBy(*_groups(color, x))


def area(df: DataFrame, x: str, y: str | None, color: str | None = None) -> DataFrame:
    """Stacked totals per x (and color) and the running total over x."""
    name = f"sum_{y}" if y else "count"
    g = bar(df, x, y, color)
    return running_sum(g, name, x, [color] if color else None, out="cumulative")


def wide_form(df: DataFrame, x: str, ys: list[str], cumulative: bool = False) -> DataFrame:
    """Line/area without y: every other numeric column, long form (x, variable, value)."""
    long = df.select(col(x), F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), col(c).cast("double").alias("value")) for c in ys])))
    g = long.groupBy(col(x), "variable").agg(F.sum("value").alias("value"))
    if cumulative:
        g = running_sum(g, "value", x, ["variable"], out="cumulative")
    return g


# H6 ---------------------------------------------------------------------------
def scatter(df: DataFrame, x: str, y: str, color: str | None = None,
            max_points: int | None = None, seed: int = 42) -> DataFrame:
    """(x, y[, color]) points. ``max_points`` (optional) keeps a deterministic
    hash-ranked subset — a sampling feature for drawing, off by default."""
    out = df.select(*_groups(x, y, color))
    if max_points is None:
        return out
    h = F.xxhash64(*[col(c) for c in out.columns], F.lit(seed))
    return out.withColumn("_h", h).orderBy("_h").limit(max_points).drop("_h")


# H8-H10 -----------------------------------------------------------------------
def pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """sum(y) per x with its share; without y, value counts with share. The
    total is one global aggregate, attached as a literal (no join, no
    single-task window)."""
    name = f"sum_{y}" if y else "count"
    g = df.groupBy(col(x)).agg(_agg(y).alias(name))
    total = df.agg(_agg(y).alias("t")).first()["t"]
    return g.withColumn("share", (F.col(name) / F.lit(float(total))) if total else F.lit(None).cast("double"))


def treemap(df: DataFrame, path: list[str], y: str | None = None) -> DataFrame:
    name = f"sum_{y}" if y else "count"
    return df.groupBy(*_groups(*path)).agg(_agg(y).alias(name))


def funnel(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Stages by value (largest first), with the share of the first stage and
    of the previous stage. Ranks come from ranges of (value, stage), and each stage
    meets the one before by its rank, so any number of stages works."""
    name = f"sum_{y}" if y else "count"
    g = df.groupBy(col(x)).agg(_agg(y).alias(name))
    ranked = cut_lineage(global_rank(g, [F.col(name).desc(), col(x).asc()], "stage"))
    top = ranked.agg(F.max(F.when(F.col("stage") == 1, F.col(name))).alias("v")).first()["v"]
    before = ranked.select((F.col("stage") + 1).alias("stage"), F.col(name).alias("_before"))
    return ranked.join(before, "stage", "left").select(
        col(x), F.col(name), F.col("stage").cast("int").alias("stage"),
        F.try_divide(F.col(name), F.lit(top)).cast("double").alias("pct_of_first"),
        F.try_divide(F.col(name), F.col("_before")).cast("double").alias("pct_of_previous"))


# H13 --------------------------------------------------------------------------
def sunburst(df: DataFrame, levels: list[str], y: str | None = None) -> DataFrame:
    """Totals for every prefix of the level path (rollup), plus the grand total."""
    name = f"sum_{y}" if y else "count"
    return (df.rollup(*_groups(*levels)).agg(_agg(y).alias(name), F.grouping_id().alias("level_id")))


def heatmap(df: DataFrame, x: str, y: str, z: str | None = None, how: str = "avg") -> DataFrame:
    name = f"{how}_{z}" if z else "count"
    return df.groupBy(col(x), col(y)).agg(_agg(z, how).alias(name))


def xyz(df: DataFrame, x: str, y: str, z: str, color: str | None = None) -> DataFrame:
    return df.select(*_groups(x, y, z, color))


def surface(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    return df.groupBy(col(x), col(y)).agg(F.avg(col(z)).alias(f"avg_{z}"))


def bar_3d(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    return df.groupBy(col(x), col(y)).agg(F.sum(col(z)).alias(f"sum_{z}"))
