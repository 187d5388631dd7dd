"""Feature filter (F1-F4): drop uninformative columns.

Rules in order, first hit gives the reason:
  F1 zero variance: distinct values counting NULL <= 1;
  F2 ID-named: lower name in {id, uuid, index} or ends with "_id"/" id", and
     distinct non-null > 0.5 * rows (strict);
  F3 unique text: text column whose distinct non-null count equals the rows.
An empty frame is returned unchanged. The fit is one pass over the
value-frequency table; the result is one small row per column.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import column_summary

# ID names and the three justification texts.
ID_NAMES = ("id", "uuid", "index")
ID_SUFFIXES = ("_id", " id")
REASON_ZERO_VARIANCE = "Zero-variance (All values are identical or completely missing)."
REASON_ID = "Detected as a primary key/ID by name ('{col}')."
REASON_UNIQUE_TEXT = "100% unique string values (Likely a primary key or arbitrary identifier)."


def is_id_name(name: str) -> bool:
    low = str(name).lower()
    return low in ID_NAMES or low.endswith(ID_SUFFIXES)


def rule_columns(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """(position, column, zero_variance, id_named, unique_text, rule, reason).

    Each rule flag is evaluated independently; ``rule`` applies the order."""
    s = column_summary(df) if summary is None else summary
    ids = [c for c in df.columns if is_id_name(c)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nonempty = F.col("n_rows") > 0
    in_list = lambda names: F.col("column").isin(names) if names else F.lit(False)
    zero_var = nonempty & (F.col("cardinality") <= 1)
    id_named = nonempty & in_list(ids) & (F.col("distinct_nonnull") > F.col("n_rows") * 0.5)
    unique_text = nonempty & in_list(texts) & (F.col("distinct_nonnull") == F.col("n_rows"))
    rule = (F.when(zero_var, "zero_variance").when(id_named, "id_named")
            .when(unique_text, "unique_text"))
    reason = (F.when(zero_var, REASON_ZERO_VARIANCE)
              .when(id_named, F.concat(F.lit("Detected as a primary key/ID by name ('"),
                                       F.col("column"), F.lit("').")))
              .when(unique_text, REASON_UNIQUE_TEXT))
    return s.select("position", "column", zero_var.alias("zero_variance"),
                    id_named.alias("id_named"), unique_text.alias("unique_text"),
                    rule.alias("rule"), reason.alias("reason"))


def drop_log(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """(position, column, rule, reason) for every column the filter drops."""
    return (rule_columns(df, summary).where(F.col("rule").isNotNull())
            .select("position", "column", "rule", "reason"))


@dataclass
class FeatureFilter:
    """Fitted filter: the columns to drop, in column order, with reasons."""
    drops: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.drops]
        return df.select(*[F.col(f"`{c}`") for c in keep])


def fit_feature_filter(df: DataFrame, summary: DataFrame | None = None) -> FeatureFilter:
    rows = drop_log(df, summary).orderBy("position").collect()  # one row per column at most
    return FeatureFilter({r["column"]: r["reason"] for r in rows})


def filter_features(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    ff = fit_feature_filter(df)
    return ff.transform(df), ff.drops
