"""Column profiling, data-health scoring and distribution statistics.

Design: one value-frequency table ``vf(position, column, value, cnt)`` built by
exploding each row into (column, stringified value) pairs and counting them in a
single shuffle with map-side partial aggregation. A hot value (one value holding a
third of the rows) is pre-aggregated inside each map task, so no reducer sees
more than one partial row per (column, value) per map task. Cardinality, nulls,
dominance, top-k, mode and vocabularies are all read from it instead of running
``count_distinct`` per column (which would ``Expand`` the data k-fold once per
aggregate) or ``mode`` (an unbounded per-group hash map).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import moments_frame
from ..functions.quantiles import exact_quantiles
from ..functions.rows import row_hash
from ..functions.texttop import mean_length, top_text
from ..functions.windows import global_rank
from ..functions.types import (NUMERIC, col, logical_types,
                               normalize_missing, numeric_columns, value_key)

VF_SCHEMA = "position int, column string, value string, cnt bigint"


def frequency_table(df: DataFrame, columns: list[str] | None = None,
                    text: str = "value") -> DataFrame:
    """(position, column, value, cnt) for every distinct value of every column.

    NULL is kept as its own value row so that cardinality-with-null and null
    counts come from the same table. Rows are grouped on a typed key
    (integral value, fractional value, text) so that numbers are not formatted
    before the shuffle; values become strings only on the aggregated result.
    -0.0 and 0.0 are one value (Spark normalises floating grouping keys).

    One pass emits (column, value) pairs per row, so the input is read and parsed
    once whatever it is (a scan, a CSV file, a plan with shuffles).

    ``text="hash"`` (for consumers that need counts only: cardinality, nulls,
    dominance) groups text values by a 96-bit hash pair (xxhash64 + murmur3)
    instead of the string itself, so long texts are never shuffled; the
    ``value`` of such rows is then a hash string, not the text. The chance
    that two of 10^9 distinct texts collide is about 10^-11."""
    names = list(df.columns)
    wanted = names if columns is None else list(columns)
    if not wanted:
        return df.sparkSession.createDataFrame([], VF_SCHEMA)
    null_l, null_d, null_s = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))

    def key(c):
        dt = df.schema[c].dataType
        x = col(c)
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return x.cast("bigint"), null_d, null_s
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return null_l, x.cast("double"), null_s
        # decimals print exactly, values of one scale in one way (value_key below)
        if text == "hash" and isinstance(dt, T.StringType):
            return (F.when(x.isNotNull(), F.xxhash64(x)), F.when(x.isNotNull(), F.hash(x).cast("double")),
                    null_s)
        return null_l, null_d, value_key(df, c)

    entries = [F.struct(F.lit(names.index(c)).alias("p"), *[e.alias(n) for e, n in zip(key(c), "lds")])
               for c in wanted]
    counted = (df.select(F.inline(F.array(*entries)))
               .groupBy("p", "l", "d", "s").agg(F.count(F.lit(1)).alias("cnt")))
    name_of = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p") + 1)
    value = F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("s"))
    return counted.select(F.col("p").cast("int").alias("position"), name_of.alias("column"),
                          value.alias("value"), "cnt")


def _column_meta(df: DataFrame) -> DataFrame:
    kinds = logical_types(df)
    rows = [(i, c, kinds[c]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def column_summary(df: DataFrame, vf: DataFrame | None = None) -> DataFrame:
    """Per column: rows, nulls, distinct with and without null, top non-null count.

    Output has one row per column (bounded by the column count), so it is safe
    to broadcast and to collect. Only counts are needed, so text values are
    grouped by hash (``frequency_table(text="hash")``)."""
    if vf is None:
        df = normalize_missing(df, exact=True)
        vf = frequency_table(df, text="hash")
    stats = vf.groupBy("position").agg(
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("cnt")).otherwise(0)).alias("null_count"),
        F.count(F.lit(1)).alias("cardinality"),
        F.count("value").alias("distinct_nonnull"),
        F.max(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("top_count"),
    )
    meta = _column_meta(df)
    out = meta.join(F.broadcast(stats), "position", "left")
    return out.select(
        "position", "column", "dtype",
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("null_count", F.lit(0)).cast("bigint").alias("null_count"),
        F.coalesce("cardinality", F.lit(0)).cast("bigint").alias("cardinality"),
        F.coalesce("distinct_nonnull", F.lit(0)).cast("bigint").alias("distinct_nonnull"),
        F.coalesce("top_count", F.lit(0)).cast("bigint").alias("top_count"),
    )


def profile_schema(df: DataFrame, vf: DataFrame | None = None) -> DataFrame:
    """(position, column, dtype, null_count, null_percentage, cardinality).

    Cardinality counts NULL as one value; null % is 0 for an empty frame."""
    s = column_summary(df, vf)
    pct = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(
        F.col("null_count") * 100.0 / F.col("n_rows"))
    return s.select("position", "column", "dtype", "null_count",
                    pct.cast("double").alias("null_percentage"), "cardinality")


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"))


def distinct_row_count(df: DataFrame) -> DataFrame:
    """(n_rows, n_distinct) with NULLs equal, after NaN -> NULL.

    One aggregate over two 64-bit content hashes per row: rows themselves are not
    shuffled, copies of a hot row collapse inside each map task."""
    norm = normalize_missing(df, exact=True)
    if not norm.columns:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows", F.when(F.col("n_rows") > 0, 1).otherwise(0).cast("bigint").alias("n_distinct"))
    h1, h2 = row_hash(norm)
    groups = norm.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    return groups.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("n_rows"),
                      F.count(F.lit(1)).alias("n_distinct"))


def health_components(df: DataFrame, vf: DataFrame | None = None) -> DataFrame:
    """P2-P5 in one row: null_cell_pct, duplicate_row_pct, dominant_pct, health_score.

    Two scans of the input (frequency table, row groups); their one-row results
    are combined by union + aggregate, never by a join."""
    df = normalize_missing(df, exact=True)
    n_cols = len(df.columns)
    s = column_summary(df, vf)
    per_col = s.agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_cells"),
        F.coalesce(F.sum(F.when((F.col("top_count") > 0) & (
            F.col("top_count") * 100 > F.col("n_rows").__sub__(F.col("null_count")) * 95), 1)
            .otherwise(0)), F.lit(0)).alias("dominant"),
    ).select("null_cells", "dominant", F.lit(None).cast("bigint").alias("n_rows"),
             F.lit(None).cast("bigint").alias("n_distinct"))
    dup = distinct_row_count(df).select(F.lit(None).cast("bigint").alias("null_cells"),
                                        F.lit(None).cast("bigint").alias("dominant"),
                                        "n_rows", "n_distinct")
    both = per_col.unionByName(dup).agg(
        F.max("null_cells").alias("null_cells"), F.max("dominant").alias("dominant"),
        F.max("n_rows").alias("n_rows"), F.max("n_distinct").alias("n_distinct"))
    rows = F.col("n_rows")
    empty = (rows == 0) | F.lit(n_cols == 0)
    null_pct = F.when(empty, 0.0).otherwise(
        F.col("null_cells") / (rows * F.lit(max(n_cols, 1))) * 100.0)
    dup_pct = F.when(empty, 0.0).otherwise((rows - F.col("n_distinct")) / rows * 100.0)
    dom_pct = F.when(empty, 0.0).otherwise(F.col("dominant") / F.lit(max(n_cols, 1)) * 100.0)
    out = both.select("n_rows", null_pct.cast("double").alias("null_cell_pct"),
                      dup_pct.cast("double").alias("duplicate_row_pct"),
                      dom_pct.cast("double").alias("dominant_pct"),
                      F.coalesce(F.col("dominant"), F.lit(0)).cast("bigint").alias("dominant_columns"))
    penalty = (F.col("null_cell_pct") * 0.5 + F.col("duplicate_row_pct") * 0.3
               + F.col("dominant_pct") * 0.2)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty)), 2)
    return out.select("null_cell_pct", "duplicate_row_pct", "dominant_pct", "dominant_columns",
                      F.when(empty, 0.0).otherwise(score).cast("double").alias("health_score"))


def health_score(df: DataFrame) -> DataFrame:
    """P5: one-row frame with the health score and its components."""
    h = health_components(df)
    return h.withColumn("health_label", health_label(F.col("health_score")))


def health_label(score: Column) -> Column:
    """>= 80 Excellent, >= 50 Needs Review, else Critical."""
    return (F.when(score >= 80, "Excellent").when(score >= 50, "Needs Review")
            .otherwise("Critical"))


# ---------------------------------------------------------------------------
# value counts, top-k, mode, class balance

LONG_TEXT = 64     # mean characters above which top-k/mode of a text column go by hash


def _long_text_columns(df: DataFrame, columns: list[str], text: str) -> list[str]:
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if text == "value" or not texts:
        return []
    if text == "hash":
        return texts
    lengths = mean_length(df, texts)                        # one small aggregate
    return [c for c in texts if lengths[c] > LONG_TEXT]


def _text_tops(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame | None, list[str]]:
    """(column, rank, value, cnt) of long-text columns computed by hash, plus the
    columns that fell back to grouping by value."""
    names = list(df.columns)
    rows, fallback = [], []
    for c in columns:
        got = top_text(df, c, k)
        if got is None:
            fallback.append(c)
            continue
        rows += [(names.index(c), c, i + 1, v, n) for i, (v, n) in enumerate(got)]
    frame = df.sparkSession.createDataFrame(rows, "position int, column string, rank int, value string, cnt bigint")
    return frame, fallback


def top_values(df: DataFrame, k: int | None = 8, columns: list[str] | None = None,
               vf: DataFrame | None = None, text: str = "auto") -> DataFrame:
    """(column, rank, value, cnt): most frequent non-null values per column.

    Ties are broken by the value (ascending) so the result is reproducible.
    The window runs over the frequency table partitioned by column; ``k`` is the
    reported size (a top-k report), not a cap on the work."""
    columns = list(df.columns) if columns is None else list(columns)
    hashed_tops = None
    if vf is None and k is not None:
        # long texts: exact top-k by hash, the texts themselves are not shuffled
        longs = _long_text_columns(df, columns, text)
        if longs:
            hashed_tops, back = _text_tops(df, longs, k)
            columns = [c for c in columns if c not in longs or c in back]
    if vf is None and not columns:
        return hashed_tops.select("column", "rank", "value", "cnt")
    vf = frequency_table(df, columns) if vf is None else vf
    if k is None:
        # every value is wanted: ranked over ranges of (column, count, value)
        order = [F.col("position").asc(), F.col("cnt").desc(), F.col("value").asc()]
        ranked = global_rank(vf.where(F.col("value").isNotNull()), order, "r")
        first = ranked.groupBy("position").agg(F.min("r").alias("first"))   # one row per column
        return ranked.join(F.broadcast(first), "position").select(
            "column", (F.col("r") - F.col("first") + 1).cast("int").alias("rank"), "value", "cnt")
    w = Window.partitionBy("position").orderBy(F.col("cnt").desc(), F.col("value").asc())
    ranked = vf.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(w))
    ranked = ranked.where(F.col("rank") <= k)
    out = ranked.select("column", F.col("rank").cast("int").alias("rank"), "value", "cnt")
    if hashed_tops is not None:
        out = out.unionByName(hashed_tops.select("column", "rank", "value", "cnt"))
    return out


def modes(df: DataFrame, columns: list[str] | None = None,
          vf: DataFrame | None = None, text: str = "auto") -> DataFrame:
    """(column, mode, mode_count): most frequent non-null value, smallest on a tie.

    "Smallest" follows the column's own ordering (numbers numerically, text by
    code point), as pandas' sorted mode does."""
    columns = list(df.columns) if columns is None else list(columns)
    hashed = None
    if vf is None:
        longs = _long_text_columns(df, columns, text)
        if longs:
            tops, back = _text_tops(df, longs, 1)
            hashed = tops.select("column", F.col("value").alias("mode"), F.col("cnt").alias("mode_count"))
            columns = [c for c in columns if c not in longs or c in back]
            if not columns:
                return hashed
    vf = frequency_table(df, columns) if vf is None else vf
    kinds = logical_types(df)
    # order key that sorts like the original type
    num = [c for c in columns if kinds[c] == NUMERIC]
    order_num = F.when(F.col("column").isin(num) if num else F.lit(False),
                       F.col("value").cast("double"))
    w = Window.partitionBy("position").orderBy(F.col("cnt").desc(), order_num.asc_nulls_last(),
                                               F.col("value").asc())
    out = (vf.where(F.col("value").isNotNull())
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
           .select("column", F.col("value").alias("mode"), F.col("cnt").alias("mode_count")))
    return out if hashed is None else out.unionByName(hashed)


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt, share) of a column's non-null values."""
    vf = frequency_table(df, [column]).where(F.col("value").isNotNull())
    total = df.agg(F.count(col(column)).alias("n")).first()["n"]   # one global aggregate
    share = (F.col("cnt") / F.lit(float(total))) if total else F.lit(None)
    return vf.select(F.col("value").alias(column), "cnt", share.cast("double").alias("share"))


# ---------------------------------------------------------------------------
# numeric and categorical statistics

def numeric_stats(df: DataFrame, columns: list[str] | None = None,
                  quantiles: str = "auto") -> DataFrame:
    """One row per numeric column: count, mean, median, std (sample), min, max,
    skewness (bias-corrected G1), null_count, q25, q75.

    Moments come from ``moments_frame`` (one aggregate; long form for wide
    frames). Quartiles are computed up front (``"auto"``: exact two-pass
    selection; ``"exact"``: Spark ``percentile``; ``"approx"``: sketch) and
    attached by column name."""
    df = normalize_missing(df)
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], NUMERIC_STATS_SCHEMA)
    qs = exact_quantiles(df, {c: col(c) for c in columns}, [0.25, 0.5, 0.75], quantiles)
    qmap = F.create_map(*[x for c in columns for x in (
        F.lit(c), F.array(*[F.lit(v).cast("double") for v in qs[c]]))])
    m = moments_frame(df, columns, want=("n", "rows", "mean", "var_pop", "std_samp", "g1", "min", "max"))
    n = F.col("n").cast("double")
    big_g1 = (F.when(F.col("n") < 3, F.lit(None).cast("double"))
              .when(F.col("var_pop") == 0, F.lit(0.0))
              .otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)))
    q = qmap[F.col("column")]
    return m.select("column", F.col("n").alias("count"), "mean", q[1].alias("median"),
                    F.col("std_samp").alias("std"), "min", "max", big_g1.alias("skewness"),
                    (F.col("rows") - F.col("n")).alias("null_count"), q[0].alias("q25"), q[2].alias("q75"))


NUMERIC_STATS_SCHEMA = ("column string, count bigint, mean double, median double, std double, "
                        "min double, max double, skewness double, null_count bigint, "
                        "q25 double, q75 double")


def distribution_stats(df: DataFrame, column: str, quantiles: str = "auto") -> DataFrame:
    """P8 for one numeric column, with unique_values, values rounded to 4."""
    s = numeric_stats(df, [column], quantiles)
    u = frequency_table(df, [column]).agg(F.count("value").alias("unique_values"))
    s = _attach_one_row(s, u)
    r = lambda c: F.round(F.col(c), 4).alias(c)
    return s.select("column", "count", r("mean"), r("median"), r("std"), r("min"), r("max"),
                    r("skewness"), "null_count", "unique_values", r("q25"), r("q75"))


def _attach_one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to a one-row frame (union + max;
    no join)."""
    lcols = [c for c in left.columns]
    rcols = [c for c in right.columns]
    ltypes = dict(left.dtypes)
    rtypes = dict(right.dtypes)
    a = left.select(*[F.col(c) for c in lcols],
                    *[F.lit(None).cast(rtypes[c]).alias(c) for c in rcols])
    b = right.select(*[F.lit(None).cast(ltypes[c]).alias(c) for c in lcols],
                     *[F.col(c) for c in rcols])
    return a.unionByName(b).agg(*[F.max(c).alias(c) for c in lcols + rcols])


def categorical_stats(df: DataFrame, columns: list[str] | None = None,
                      vf: DataFrame | None = None) -> DataFrame:
    """(column, count, unique_values, null_count, mode, mode_count)."""
    df = normalize_missing(df)
    kinds = logical_types(df)
    columns = [c for c in df.columns if kinds[c] != NUMERIC] if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, unique_values bigint, null_count bigint, "
                "mode string, mode_count bigint")
    # counts need hashes only; modes fetch the text of the most frequent hash
    s = column_summary(df, frequency_table(df, columns, text="hash") if vf is None else vf) \
        .where(F.col("column").isin(columns))
    m = modes(df, columns, vf)
    return (s.join(F.broadcast(m), "column", "left")
            .select("column", (F.col("n_rows") - F.col("null_count")).alias("count"),
                    F.col("distinct_nonnull").alias("unique_values"), "null_count",
                    "mode", "mode_count"))


def column_stats(df: DataFrame) -> DataFrame:
    """(column, dtype, min, max, mean, unique_count) — min/max/mean
    (mean rounded to 2) for numeric columns, NULL otherwise."""
    df = normalize_missing(df)
    kinds = logical_types(df)
    nums = [c for c in df.columns if kinds[c] == NUMERIC]
    summ = column_summary(df)
    if nums:
        num = moments_frame(df, nums, want=("mean", "min", "max")).select(
            "column", "min", "max", F.round("mean", 2).alias("mean"))
        summ = summ.join(F.broadcast(num), "column", "left")      # one row per column
    else:
        summ = summ.select("*", *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean")])
    return summ.select("column", "dtype", "min", "max", "mean",
                       F.col("distinct_nonnull").alias("unique_count"))


def describe_columns(df: DataFrame, quantiles: str = "auto") -> DataFrame:
    """One sentence per column from its statistics.

    numeric: mean/median/std/range/n to 2 decimals; categorical: distinct count,
    n, mode and the mode's share of all rows (nulls included)."""
    df = normalize_missing(df)
    kinds = logical_types(df)
    nums = [c for c in df.columns if kinds[c] == NUMERIC]
    cats = [c for c in df.columns if kinds[c] != NUMERIC]
    f2 = lambda c: F.format_string("%.2f", F.round(F.col(c), 2))
    parts = []
    if nums:
        s = numeric_stats(df, nums, quantiles)
        parts.append(s.select("column", F.concat(
            F.lit("Distribution of '"), F.col("column"), F.lit("': mean="), f2("mean"),
            F.lit(", median="), f2("median"), F.lit(", std="), f2("std"),
            F.lit(", range=["), f2("min"), F.lit(", "), f2("max"), F.lit("], n="),
            F.col("count").cast("string"), F.lit(".")).alias("description")))
    if cats:
        c = categorical_stats(df, cats)
        share = F.round(F.col("mode_count") * 100.0 / (F.col("count") + F.col("null_count")), 1)
        parts.append(c.select("column", F.concat(
            F.lit("Distribution of '"), F.col("column"), F.lit("': "),
            F.col("unique_values").cast("string"), F.lit(" unique values, n="),
            F.col("count").cast("string"), F.lit(". Most frequent: '"), F.col("mode"),
            F.lit("' ("), F.format_string("%.1f", share), F.lit("%).")).alias("description")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, description string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_matrix(df: DataFrame, order_by: str, buckets: int = 20, wide: int = 32) -> DataFrame:
    """Nulls per (row bucket, column), for a missing-value heat map.

    Buckets are equal-width ranges of the order key (row position when the key
    is a dense row id). Counting happens per bucket in one aggregate over the
    original rows; only the small (bucket x column) result is unpivoted."""
    df = normalize_missing(df)
    key = col(order_by).cast("double")
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    b = bounds.first()
    lo, hi = (b["lo"], b["hi"]) if b is not None else (None, None)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bucket int, column string, null_count bigint, n_rows bigint")
    width = (hi - lo + 1.0) / buckets
    bucket = F.least(F.floor((key - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
    cols = [c for c in df.columns if c != order_by]
    if len(cols) > wide:
        # long form: a fixed aggregate grouped by (bucket, column) for wide frames
        long = df.select(bucket.alias("bucket"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), col(c).isNull().cast("int").alias("z")) for c in cols])))
        return long.groupBy("bucket", "column").agg(F.sum("z").cast("bigint").alias("null_count"),
                                                    F.count(F.lit(1)).alias("n_rows"))
    agg = df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    return agg.select("bucket", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(cols)])), "n_rows")


def profile_schema_count_distinct(df: DataFrame) -> DataFrame:
    """P1 through per-column ``count_distinct`` aggregates (the plan the
    frequency table replaces; kept for the benchmark comparison). Spark expands
    every row once per distinct aggregate."""
    kinds = logical_types(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(col(c).isNull()).alias(f"z{i}"), F.count_distinct(col(c)).alias(f"d{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"),
                 F.col(f"z{i}").alias("null_count"),
                 F.when(F.col("n") == 0, 0.0).otherwise(F.col(f"z{i}") * 100.0 / F.col("n")).alias("null_percentage"),
                 (F.col(f"d{i}") + F.when(F.col(f"z{i}") > 0, 1).otherwise(0)).alias("cardinality"))
        for i, c in enumerate(df.columns)])))
