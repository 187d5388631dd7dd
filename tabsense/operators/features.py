"""Feature transformation (T1-T6): date parts, one-hot, label codes, booleans,
z-scores. Fits are single aggregates; transforms are projections or one join
to a vocabulary table."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import cut_lineage
from ..functions.moments import column_moments
from ..functions.types import (BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, col,
                               logical_types, normalize_missing)
from .profile import column_summary, frequency_table

SIDE = "__tabsense_side"     # hidden column of the train/test split (see ml.with_side)
ONE_HOT_MAX = 10           # fixed value: one-hot up to this cardinality, label codes above
VOCAB_BROADCAST_MAX = 1_000_000   # vocabularies up to this size are ranked in one task and broadcast
LOCAL_VOCAB_MAX = 100_000         # vocabularies up to this size are fitted on the driver
MAP_VOCAB_MAX = 64                # ... and up to this size applied as a literal map lookup


# T1 ---------------------------------------------------------------------------
def datetime_parts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """{c}_year, {c}_month, {c}_day appended at the end; the original dropped."""
    kinds = logical_types(df)
    columns = [c for c in df.columns if kinds[c] == DATETIME] if columns is None else columns
    keep = [col(c) for c in df.columns if c not in columns]
    parts = []
    for c in columns:
        parts += [F.year(col(c)).alias(f"{c}_year"), F.month(col(c)).alias(f"{c}_month"),
                  F.dayofmonth(col(c)).alias(f"{c}_day")]
    return df.select(*keep, *parts)


# T2 ---------------------------------------------------------------------------
@dataclass
class OneHot:
    """Sorted categories per column; the first is dropped; NULL matches none."""
    vocab: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = [col(c) for c in df.columns if c not in self.vocab]
        used = {c.lower() for c in df.columns if c not in self.vocab}
        for c, values in self.vocab.items():
            for v in values[1:]:
                # Spark does not tell names apart by case: a second one gets _2, _3...
                name, k = f"{c}_{v}", 2
                while name.lower() in used:
                    name, k = f"{c}_{v}_{k}", k + 1
                used.add(name.lower())
                out.append(F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(name))
        return df.select(*out)


def fit_one_hot(df: DataFrame, columns: list[str], vf: DataFrame | None = None) -> OneHot:
    """Vocabularies from one frequency-table job (each at most ONE_HOT_MAX values)."""
    if not columns:
        return OneHot()
    vf = frequency_table(df, columns) if vf is None else vf.where(F.col("column").isin(columns))
    vf = vf.where(F.col("value").isNotNull())
    rows = vf.select("column", "value").collect()   # <= 10 values per column by construction
    vocab = {c: [] for c in columns}
    for r in rows:
        vocab[r["column"]].append(r["value"])
    return OneHot({c: sorted(v) for c, v in vocab.items()})


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    return fit_one_hot(df, columns).transform(df)


# T3 ---------------------------------------------------------------------------
def label_vocabulary(df: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """(value, code): codes 0..n-1 in sorted order of the string form (NULL is
    the string 'nan', as a string cast of a missing value gives).

    Small vocabularies are ranked by one window in one task (bounded by
    VOCAB_BROADCAST_MAX rows). Larger ones are ranked distributed: range
    partition + sort, per-partition counts, prefix offsets over the (few)
    partition rows, then local row numbers; the result is checkpointed so the
    codes stay fixed if a task is re-run."""
    values = (df.select(F.coalesce(col(column).cast("string"), F.lit("nan")).alias("value"))
              .distinct())
    if size is not None and size <= VOCAB_BROADCAST_MAX:
        w = Window.orderBy("value")
        return values.select("value", (F.row_number().over(w) - 1).cast("int").alias("code"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = (values.repartitionByRange(parts, "value").sortWithinPartitions("value")
              .withColumn("_p", F.spark_partition_id()))
    ranged = cut_lineage(ranged)
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("value")))
    counts = ranged.groupBy("_p").count()
    offs = counts.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_o"))
    return (local.join(F.broadcast(offs), "_p")
            .select("value", (F.coalesce("_o", F.lit(0)) + F.col("_r") - 1).cast("int").alias("code")))


@dataclass
class LabelEncoder:
    vocab: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    maps: dict[str, list[str]] = field(default_factory=dict)   # tiny vocabularies, sorted

    def transform(self, df: DataFrame) -> DataFrame:
        """Tiny vocabularies (<= MAP_VOCAB_MAX values) are a literal map lookup
        in the projection; others are joined (broadcast when their size is
        known to be <= VOCAB_BROADCAST_MAX), all joins first and one final
        projection."""
        if not self.vocab and not self.maps:
            return df
        key = {c: f"_lv{i}" for i, c in enumerate(list(self.vocab) + list(self.maps))}
        text = lambda c: F.coalesce(col(c).cast("string"), F.lit("nan"))
        out = df.select("*", *[text(c).alias(key[c]) for c in self.vocab])
        for c, v in self.vocab.items():
            right = v.select(F.col("value").alias(key[c]), F.col("code").alias(f"_lc_{key[c]}"))
            if self.sizes.get(c, VOCAB_BROADCAST_MAX + 1) <= VOCAB_BROADCAST_MAX:
                right = F.broadcast(right)
            out = out.join(right, key[c], "left")
        codes = {c: F.col(f"_lc_{key[c]}") for c in self.vocab}
        for c, values in self.maps.items():
            m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
            codes[c] = m[text(c)]
        return out.select(*[codes[c].cast("int").alias(c) if c in codes else col(c) for c in df.columns])


def fit_label_encoder(df: DataFrame, columns: list[str], sizes: dict[str, int] | None = None) -> LabelEncoder:
    """Vocabularies of known size <= LOCAL_VOCAB_MAX are read in one
    frequency-table job (bounded: at most that many values per column), ranked
    on the driver and kept as small tables (broadcast at transform time, never
    recomputed from the input). Larger ones use the distributed ranking."""
    sizes = dict(sizes or {})
    small = [c for c in columns if sizes.get(c, LOCAL_VOCAB_MAX + 1) <= LOCAL_VOCAB_MAX]
    vocab: dict[str, DataFrame] = {}
    maps: dict[str, list[str]] = {}
    if small:
        spark = df.sparkSession
        found: dict[str, set] = {c: set() for c in small}
        for r in frequency_table(df, small).select("column", "value").collect():
            found[r["column"]].add("nan" if r["value"] is None else r["value"])
        for c in small:
            values = sorted(found[c])
            if len(values) <= MAP_VOCAB_MAX:
                maps[c] = values
            else:
                vocab[c] = spark.createDataFrame([(v, i) for i, v in enumerate(values)],
                                                 "value string, code int")
    for c in columns:
        if c not in vocab and c not in maps:
            vocab[c] = label_vocabulary(df, c, sizes.get(c))
    return LabelEncoder(vocab, sizes, maps)


def label_encode(df: DataFrame, columns: list[str], sizes: dict[str, int] | None = None) -> DataFrame:
    if sizes is None:
        s = column_summary(df.select(*[col(c) for c in columns])).collect()
        sizes = {r["column"]: r["cardinality"] for r in s}
    return fit_label_encoder(df, columns, sizes).transform(df)


# T4 ---------------------------------------------------------------------------
def bool_to_int(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kinds = logical_types(df)
    columns = [c for c in df.columns if kinds[c] == BOOLEAN] if columns is None else columns
    return df.select(*[col(c).cast("int").alias(c) if c in columns else col(c) for c in df.columns])


# T5 ---------------------------------------------------------------------------
@dataclass
class ZScore:
    stats: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.stats:
                out.append(col(c))
                continue
            mean, sd = self.stats[c]
            x = col(c).cast("double")
            if mean is None:
                out.append(x.alias(c))
            elif not sd:
                out.append(F.when(x.isNotNull(), F.lit(0.0)).alias(c))
            else:
                out.append(((x - F.lit(mean)) / F.lit(sd)).alias(c))
        return df.select(*out)


def fit_zscore(df: DataFrame, columns: list[str]) -> ZScore:
    """Mean and population std of every column in one aggregate."""
    if not columns:
        return ZScore()
    mom = column_moments(normalize_missing(df), columns, want=("mean", "std_pop"))
    return ZScore({c: (mom[c]["mean"], mom[c]["std_pop"]) for c in columns})


def zscore(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kinds = logical_types(df)
    columns = [c for c in df.columns if kinds[c] == NUMERIC] if columns is None else columns
    return fit_zscore(df, columns).transform(df)


# T6 ---------------------------------------------------------------------------
@dataclass
class TransformPlan:
    datetime_cols: list[str]
    onehot: OneHot
    labels: LabelEncoder
    bools: list[str]
    scale: ZScore
    target: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        out = datetime_parts(df, [c for c in self.datetime_cols if c in df.columns])
        out = self.onehot.transform(out)
        out = self.labels.transform(out)
        out = bool_to_int(out, [c for c in self.bools if c in out.columns])
        return self.scale.transform(out)


def fit_transform_plan(df: DataFrame, profile_rows: list | None = None,
                       target: str | None = None, vf: DataFrame | None = None) -> TransformPlan:
    """T1-T5 from the profile of ``df``: datetime -> parts; categorical with
    cardinality <= 10 -> one-hot, above -> label codes; boolean -> 0/1;
    schema-numeric columns -> z-score (derived columns are not scaled).

    ``target`` (if given) is left untouched, except that a categorical target
    gets label codes so that a classifier can use it."""
    if profile_rows is None:
        profile_rows = column_summary(df).collect()       # one row per column
    info = {r["column"]: r for r in profile_rows}
    names = [c for c in df.columns if c != SIDE]          # the split's column passes through
    dts = [c for c in names if info[c]["dtype"] == DATETIME and c != target]
    cats = [c for c in names if info[c]["dtype"] == CATEGORICAL]
    oh = [c for c in cats if info[c]["cardinality"] <= ONE_HOT_MAX and c != target]
    lab = [c for c in cats if c not in oh]
    bools = [c for c in names if info[c]["dtype"] == BOOLEAN and c != target]
    nums = [c for c in names if info[c]["dtype"] == NUMERIC and c != target]
    return TransformPlan(
        dts, fit_one_hot(df, oh, vf),
        fit_label_encoder(df, lab, {c: info[c]["cardinality"] for c in lab}),
        bools, fit_zscore(df, nums), target)


def transform(df: DataFrame, profile_rows: list | None = None, target: str | None = None) -> DataFrame:
    return fit_transform_plan(df, profile_rows, target).transform(df)
