"""Target and task detection."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import NUMERIC, col, logical_types
from .profile import column_summary

# Name hints for the target, thresholds and the texts of the
# heuristic domain context.
TARGET_HINTS = ("target", "is_", "status", "churn", "price", "salary", "outcome")
REGRESSION_MIN_CARDINALITY = 10
CLASSIFICATION_MAX_UNIQUE = 20
METRIC_REGRESSION = "RMSE, MAE, R² (Inferred Regression)"
METRIC_CLASSIFICATION = "Accuracy, F1-Score, ROC-AUC (Inferred Classification)"
SUMMARY_REGRESSION = "Predicting continuous numeric values based on historical trends."
SUMMARY_CLASSIFICATION = "Categorizing or classifying outcomes based on the provided features."
INDUSTRY = "General Business"


def suggest_target(columns: list[str]) -> str:
    """First column whose lower-case name contains a hint, else the last."""
    for c in columns:
        if any(h in str(c).lower() for h in TARGET_HINTS):
            return c
    return columns[-1]


def domain_context(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """D1/D2 as a one-row frame: industry, target_variable, evaluation_metric,
    business_summary, and the two suggested questions."""
    target = suggest_target(df.columns)
    s = column_summary(df) if summary is None else summary
    row = s.where(F.col("column") == target)
    regression = (F.col("dtype") == NUMERIC) & (F.col("cardinality") > REGRESSION_MIN_CARDINALITY)
    return row.select(
        F.lit(INDUSTRY).alias("industry"), F.lit(target).alias("target_variable"),
        F.when(regression, METRIC_REGRESSION).otherwise(METRIC_CLASSIFICATION).alias("evaluation_metric"),
        F.when(regression, SUMMARY_REGRESSION).otherwise(SUMMARY_CLASSIFICATION).alias("business_summary"),
        F.lit(f"Show distribution of {target}.").alias("suggested_query_1"),
        F.lit(f"How does {target} vary across different groups?").alias("suggested_query_2"))


def task_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D3 for each column: (column, n_unique, task). Text or boolean, or at most
    20 distinct non-null values -> classification; otherwise regression."""
    columns = list(df.columns) if columns is None else columns
    kinds = logical_types(df)
    textual = [c for c in columns
               if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]
    s = column_summary(df.select(*[col(c) for c in columns]))
    is_text = F.col("column").isin(textual) if textual else F.lit(False)
    task = F.when(is_text | (F.col("distinct_nonnull") <= CLASSIFICATION_MAX_UNIQUE),
                  "classification").otherwise("regression")
    return s.select("column", F.col("distinct_nonnull").alias("n_unique"), task.alias("task"))


def detect_task(df: DataFrame, target: str) -> str:
    return task_table(df, [target]).first()["task"]
