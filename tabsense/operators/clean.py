"""Cleaning (A1-A15): names, dates, text, duplicates, missing values, ranges,
outliers.

Every data-dependent step is a *fit* (one aggregate job returning one small row
per column) followed by a pure projection, so the cleaned frame stays a lazy
plan that Catalyst optimises end to end.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import agg_row, keep
from ..functions.text import normalize_text
from ..functions.types import (DATETIME, NUMERIC, col, logical_types,
                               normalize_missing, numeric_columns, text_columns)
from ..functions.moments import column_moments
from ..functions.quantiles import exact_quantiles
from ..functions.windows import in_ranges
from .profile import modes

# Thresholds and decision-log texts of the cleaning rules.
DATE_HINT = r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss.SSS",
                "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
MISSING_DROP_PCT = 30.0
SKEW_LIMIT = 0.5
RANGE_WORDS = ("age", "salary", "price", "amount")
IQR_K = 1.5
MSG_DROP = ("Dropped column entirely due to severe missingness ({pct:.1f}% missing, which "
            "exceeds the 30% reliability threshold).")
MSG_MEDIAN = ("Imputed {pct:.1f}% missing values using the Median. Justification: Distribution "
              "is highly skewed, making median more robust than mean.")
MSG_MEAN = ("Imputed {pct:.1f}% missing values using the Mean. Justification: Distribution is "
            "relatively normal.")
MSG_FILL = ("Imputed {pct:.1f}% missing values using Forward/Backward Fill to maintain "
            "temporal continuity.")
MSG_MODE = "Imputed {pct:.1f}% missing categorical values using the Mode (most frequent value)."
MSG_NO_ORDER = ("Left {pct:.1f}% missing datetime values: forward/backward fill needs an "
                "order key (order_by).")


# ---------------------------------------------------------------------------
# A1 names

def clean_name(name: str) -> str:
    c = str(name).lower().strip().replace(" ", "_")
    return re.sub(r"[^a-z0-9_]", "", c)


def standardized_names(names: list[str]) -> list[str]:
    """Lower, strip, space -> '_', drop other symbols; collisions get _2, _3...,
    an empty result becomes col_{position}."""
    out, seen = [], set()
    for i, n in enumerate(names):
        base = clean_name(n) or f"col_{i}"
        cand, k = base, 2
        while cand in seen:
            cand, k = f"{base}_{k}", k + 1
        seen.add(cand)
        out.append(cand)
    return out


def standardize_columns(df: DataFrame) -> DataFrame:
    new = standardized_names(df.columns)
    return df.select(*[col(o).alias(n) for o, n in zip(df.columns, new)])


# ---------------------------------------------------------------------------
# A2-A5 dates and text

def detect_dates(df: DataFrame, columns: list[str] | None = None) -> dict[str, str | None]:
    """A2/A3 fit: for each text column that looks like dates, the first format in
    DATE_FORMATS that parses *every* non-null value (None: stays text).

    A cheap first aggregate counts date-like values per column; only columns
    with a hit get the (costlier) parse counts in a second aggregate."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return {}
    h = agg_row(df, [F.count_if(col(c).rlike(DATE_HINT)).alias(f"h{i}") for i, c in enumerate(columns)])
    hinted = [c for i, c in enumerate(columns) if h[f"h{i}"] > 0]
    out = {c: None for c in columns}
    if not hinted:
        return out
    aggs = []
    for i, c in enumerate(hinted):
        x = col(c)
        aggs.append(F.count(x).alias(f"n{i}"))
        for j, fmt in enumerate(DATE_FORMATS):
            aggs.append(F.count(F.try_to_timestamp(x, F.lit(fmt))).alias(f"p{i}_{j}"))
    r = agg_row(df, aggs)
    for i, c in enumerate(hinted):
        for j, f in enumerate(DATE_FORMATS):
            if r[f"p{i}_{j}"] == r[f"n{i}"]:
                out[c] = f
                break
    return out


def date_hint_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, hint_rows, nonnull, format): the date-detection evidence as a frame;
    the format is the one ``detect_dates`` (and so ``clean``) chooses."""
    columns = text_columns(df) if columns is None else columns
    formats = detect_dates(df, columns)
    r = agg_row(df, [x for i, c in enumerate(columns) for x in (
        F.count_if(col(c).rlike(DATE_HINT)).alias(f"h{i}"), F.count(col(c)).alias(f"n{i}"))])
    return df.sparkSession.createDataFrame(
        [(c, r[f"h{i}"], r[f"n{i}"], formats[c]) for i, c in enumerate(columns)],
        "column string, hint_rows bigint, nonnull bigint, format string")


def cast_dates(df: DataFrame, formats: dict[str, str | None]) -> DataFrame:
    """A3 transform: accepted columns become timestamp (wall clock, no zone)."""
    return df.select(*[
        F.to_timestamp_ntz(col(c), F.lit(formats[c])).alias(c) if formats.get(c) else col(c)
        for c in df.columns])


def clean_text(df: DataFrame, columns: list[str] | None = None,
               null_text: str = "keep") -> DataFrame:
    """A4/A5: strip + lower text columns; ``null_text="literal"`` turns NULL into
    the literal 'nan' first (as a string cast of a missing value does)."""
    columns = set(text_columns(df) if columns is None else columns)
    out = []
    for c in df.columns:
        if c in columns:
            x = col(c)
            if null_text == "literal":
                x = F.coalesce(x, F.lit("nan"))
            out.append(normalize_text(x).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


# ---------------------------------------------------------------------------
# A6 duplicates

def _dedup(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(persisted grouped frame, deduplicated rows, rows removed).

    One aggregate over all columns with a per-group row count (partial
    aggregation collapses copies of a hot row inside each map task); the
    persisted result gives both counts and the deduplicated rows, so the input
    is read once."""
    norm = normalize_missing(df, exact=True)
    if not norm.columns:
        return norm, norm, 0
    n = "__tabsense_copies"
    grouped = keep(norm.groupBy(*[col(c) for c in norm.columns]).agg(F.count(F.lit(1)).alias(n)))
    r = grouped.agg(F.sum(n).alias("before"), F.count(F.lit(1)).alias("after")).first()
    return grouped, grouped.drop(n), (r["before"] or 0) - r["after"]


def remove_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """Drop identical rows (NaN and NULL are one missing value). Returns the
    deduplicated frame (backed by a persisted aggregate) and the rows removed."""
    _, dedup, removed = _dedup(df)
    return dedup, removed


# ---------------------------------------------------------------------------
# A7-A10, A14 missing values

@dataclass
class ImputePlan:
    drop: list[str] = field(default_factory=list)
    fill: dict[str, object] = field(default_factory=dict)      # column -> constant
    as_double: list[str] = field(default_factory=list)
    ffill: list[str] = field(default_factory=list)
    order_by: list[str] | None = None
    log: dict[str, str] = field(default_factory=dict)
    methods: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.drop:
                continue
            x = col(c)
            if c in self.as_double:
                x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))   # NaN is missing
            if c in self.fill:
                x = F.coalesce(x, F.lit(self.fill[c]))
            out.append(x.alias(c))
        res = df.select(*out)
        if self.ffill:
            res = fill_forward_backward(res, self.ffill, self.order_by)
        return res


def fit_impute(df: DataFrame, order_by: str | list[str] | None = None,
               quantiles: str = "auto") -> ImputePlan:
    """A7-A10/A14 fit: one moments job (rows, nulls, mean, g1 of every column;
    long form for wide frames), exact medians only for the skewed numeric
    columns that have nulls (two-pass selection), and the modes of text columns
    that have nulls."""
    order = [order_by] if isinstance(order_by, str) else order_by
    df = normalize_missing(df)
    kinds = logical_types(df)
    mom = column_moments(df, want=("rows", "nulls", "mean", "g1"))   # one job, all columns
    r = {"rows": next(iter(mom.values()))["rows"] if mom else 0}
    for i, c in enumerate(df.columns):
        r[f"z{i}"] = mom[c]["nulls"]
        r[f"g{i}"] = mom[c]["g1"] if kinds[c] == NUMERIC else None
        r[f"m{i}"] = mom[c]["mean"] if kinds[c] == NUMERIC else None
    # medians only where they are used: numeric columns with nulls (below the drop
    # threshold) whose skewness is large or undefined
    need_median = [
        (i, c) for i, c in enumerate(df.columns)
        if kinds[c] == NUMERIC and r[f"z{i}"] and r["rows"]
        and r[f"z{i}"] / r["rows"] * 100 <= MISSING_DROP_PCT
        and (r[f"g{i}"] is None or abs(r[f"g{i}"]) > SKEW_LIMIT)]
    if need_median:
        med = exact_quantiles(df, {c: col(c) for _, c in need_median}, [0.5], quantiles)
        for i, c in need_median:
            r[f"q{i}"] = med[c][0]
    rows = r["rows"]
    plan = ImputePlan(order_by=order)
    need_mode = []
    for i, c in enumerate(df.columns):
        nulls = r[f"z{i}"]
        if not nulls:
            continue
        pct = nulls / rows * 100
        if pct > MISSING_DROP_PCT:
            plan.drop.append(c)
            plan.log[c] = MSG_DROP.format(pct=pct)
            plan.methods[c] = "drop"
        elif kinds[c] == NUMERIC:
            g1 = r[f"g{i}"]
            plan.as_double.append(c)
            if g1 is None or abs(g1) > SKEW_LIMIT:
                plan.fill[c] = float(r[f"q{i}"])
                plan.log[c] = MSG_MEDIAN.format(pct=pct)
                plan.methods[c] = "median"
            else:
                plan.fill[c] = float(r[f"m{i}"])
                plan.log[c] = MSG_MEAN.format(pct=pct)
                plan.methods[c] = "mean"
        elif kinds[c] == DATETIME:
            if order:
                plan.ffill.append(c)
                plan.log[c] = MSG_FILL.format(pct=pct)
                plan.methods[c] = "ffill_bfill"
            else:
                plan.log[c] = MSG_NO_ORDER.format(pct=pct)
                plan.methods[c] = "none"
        else:
            need_mode.append((c, pct))
    if need_mode:
        m = {row["column"]: row["mode"] for row in
             modes(df, [c for c, _ in need_mode]).collect()}  # one row per column
        for c, pct in need_mode:
            if m.get(c) is None:
                continue
            value = m[c]
            dt = df.schema[c].dataType
            plan.fill[c] = (value == "true") if isinstance(dt, T.BooleanType) else value
            plan.log[c] = MSG_MODE.format(pct=pct)
            plan.methods[c] = "mode"
    return plan


def impute(df: DataFrame, order_by=None, quantiles: str = "auto") -> tuple[DataFrame, dict]:
    plan = fit_impute(df, order_by, quantiles)
    return plan.transform(df), plan.log


# ---------------------------------------------------------------------------
# A14 scalable forward/backward fill

def fill_forward_backward(df: DataFrame, columns: list[str], order_by: list[str] | str,
                          method: str = "partitioned") -> DataFrame:
    """Forward fill, then backward fill, of ``columns`` in ``order_by`` order.

    ``method="window"``: one global window (all rows in one task; the test
    oracle). ``method="partitioned"`` (default): rows are dealt to ranges of all
    order keys and a row hash (a hot key value is split by the keys and the hash
    behind it), each range reports its last/first non-null values (one row per
    range), a carry-in per range is computed over those few rows and broadcast,
    and the fill runs as running windows *within* each range."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not columns:
        return df
    tb = F.xxhash64(*[col(c) for c in df.columns])
    ordering = [col(k).asc_nulls_last() for k in order] + [F.col("_tb").asc()]
    if method == "window":
        d = df.withColumn("_tb", tb)
        wf = Window.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
        wb = Window.orderBy(*[o for o in _desc(order)]).rowsBetween(Window.unboundedPreceding, 0)
        return d.select(*[F.coalesce(F.last(col(c), True).over(wf), F.last(col(c), True).over(wb)).alias(c)
                          if c in columns else col(c) for c in df.columns])
    d = in_ranges(df.withColumn("_tb", tb), ordering)
    # NULL keys come last in the fill's order, but first in a struct's
    ord_struct = F.struct(*[x for k in order for x in (col(k).isNull(), col(k))], F.col("_tb"))
    summ = d.groupBy("_b").agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), ord_struct)).alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.min_by(col(c), F.when(col(c).isNotNull(), ord_struct)).alias(f"f{i}") for i, c in enumerate(columns)])
    # carry-in over the per-range summary: one row per range
    wprev = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wnext = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select("_b", *[F.last(f"l{i}", True).over(wprev).alias(f"cf{i}") for i in range(len(columns))],
                        *[F.first(f"f{i}", True).over(wnext).alias(f"cb{i}") for i in range(len(columns))])
    j = d.join(F.broadcast(carry), "_b", "left")
    wf = Window.partitionBy("_b").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy("_b").orderBy(*_desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            ff = F.coalesce(F.last(col(c), True).over(wf), F.col(f"cf{i}"))
            bf = F.coalesce(F.last(col(c), True).over(wb), F.col(f"cb{i}"))
            out.append(F.coalesce(ff, bf).alias(c))
        else:
            out.append(col(c))
    return j.select(*out)


def _desc(order: list[str]) -> list[Column]:
    return [col(k).desc_nulls_first() for k in order] + [F.col("_tb").desc()]


# ---------------------------------------------------------------------------
# A11-A12 range rule and IQR winsorising

def range_rule_applies(name: str, match: str = "substring") -> bool:
    if match == "token":
        return any(w in name.split("_") for w in RANGE_WORDS)
    return any(w in name for w in RANGE_WORDS)


@dataclass
class WinsorPlan:
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    clip: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.bounds:
                out.append(col(c))
                continue
            x = F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
            if c in self.clip:
                x = F.when(x < 0, F.lit(0.0)).otherwise(x)
            lo, hi = self.bounds[c]
            if lo is not None:
                x = F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
            out.append(x.alias(c))
        return df.select(*out)

    def bounds_frame(self, spark) -> DataFrame:
        rows = [(c, c in self.clip, lo, hi) for c, (lo, hi) in self.bounds.items()]
        return spark.createDataFrame(rows, "column string, clipped boolean, lower double, upper double")


def fit_winsorize(df: DataFrame, quantiles: str = "auto", range_match: str = "substring",
                  columns: list[str] | None = None) -> WinsorPlan:
    """A11/A12 fit: exact quartiles of every numeric column (after the
    non-negative clip for range-named columns), all columns together in the
    two passes of ``exact_quantiles``."""
    nums = numeric_columns(df) if columns is None else columns
    plan = WinsorPlan()
    if not nums:
        return plan
    exprs = {}
    for c in nums:
        x = col(c).cast("double")
        if range_rule_applies(c, range_match):
            plan.clip.append(c)
            x = F.when(x < 0, F.lit(0.0)).otherwise(x)
        exprs[c] = x
    got = exact_quantiles(df, exprs, [0.25, 0.75], quantiles)
    for c in nums:
        qs = got[c]
        if qs is None or qs[0] is None:
            plan.bounds[c] = (None, None)
            continue
        q1, q3 = float(qs[0]), float(qs[1])
        iqr = q3 - q1
        plan.bounds[c] = (q1 - IQR_K * iqr, q3 + IQR_K * iqr)
    return plan


def winsorize(df: DataFrame, quantiles: str = "auto", range_match: str = "substring",
              columns: list[str] | None = None) -> DataFrame:
    return fit_winsorize(df, quantiles, range_match, columns).transform(df)


def outlier_bounds(df: DataFrame, quantiles: str = "auto", range_match: str = "substring") -> DataFrame:
    """(column, clipped, lower, upper) of the IQR rule (the fitted bounds as a frame)."""
    return fit_winsorize(df, quantiles, range_match).bounds_frame(df.sparkSession)


# ---------------------------------------------------------------------------
# A15 orchestration

@dataclass
class CleanResult:
    df: DataFrame
    log: dict[str, str]
    duplicates_removed: int
    date_formats: dict[str, str | None]
    impute: ImputePlan
    winsor: WinsorPlan
    cached: DataFrame | None = None

    def release(self) -> None:
        """Unpersist the deduplicated frame the cleaned plan reads from."""
        if self.cached is not None:
            self.cached.unpersist()

    def decisions(self, spark) -> DataFrame:
        """(phase, column_action, justification)."""
        rows = [("Cleaning", f"Modify/Drop '{c}'", r) for c, r in self.log.items()]
        if self.duplicates_removed > 0:
            rows.append(("Cleaning", "Remove Duplicates",
                         f"Removed {self.duplicates_removed} identical duplicate rows to ensure "
                         "model integrity."))
        return spark.createDataFrame(rows, "phase string, column_action string, justification string")


def clean(df: DataFrame, order_by=None, null_text: str = "keep", quantiles: str = "auto",
          range_match: str = "substring") -> CleanResult:
    """Names -> dates/text -> duplicates -> missing values -> ranges/outliers."""
    step = standardize_columns(normalize_missing(df, exact=True))
    if order_by is not None:
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        order = [standardized_names(df.columns)[df.columns.index(o)] if o in df.columns else o
                 for o in order]
    else:
        order = None
    formats = detect_dates(step)
    step = cast_dates(step, formats)
    step = clean_text(step, [c for c in text_columns(step)], null_text=null_text)
    # without an order key datetime gaps stay (and are logged): a frame has no row order
    cached, step, removed = _dedup(step)
    iplan = fit_impute(step, order, quantiles)
    step = iplan.transform(step)
    wplan = fit_winsorize(step, quantiles, range_match)
    step = wplan.transform(step)
    return CleanResult(step, dict(iplan.log), removed, formats, iplan, wplan, cached)


def impute_decisions(df: DataFrame, order_by=None) -> DataFrame:
    """A7-A10/A14 decisions as a lazy frame: (column, null_count,
    null_percentage, method), from one aggregate over the input."""
    df = normalize_missing(df)
    kinds = logical_types(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(col(c).isNull()).alias(f"z{i}"))
        aggs.append((F.skewness(col(c).cast("double")) if kinds[c] == NUMERIC
                     else F.lit(None).cast("double")).alias(f"g{i}"))
    wide = df.agg(*aggs)
    long = wide.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"),
                 F.col(f"z{i}").alias("null_count"), F.col(f"g{i}").alias("g1"))
        for i, c in enumerate(df.columns)])))
    pct = F.when(F.col("rows") == 0, 0.0).otherwise(F.col("null_count") * 100.0 / F.col("rows"))
    method = (F.when(F.col("null_count") == 0, "none")
              .when(pct > MISSING_DROP_PCT, "drop")
              .when((F.col("dtype") == NUMERIC) & (F.col("g1").isNull() | (F.abs("g1") > SKEW_LIMIT)), "median")
              .when(F.col("dtype") == NUMERIC, "mean")
              .when(F.col("dtype") == DATETIME, F.lit("ffill_bfill" if order_by else "none"))
              .otherwise("mode"))
    return long.select("column", "null_count", pct.cast("double").alias("null_percentage"),
                       method.alias("method"))
