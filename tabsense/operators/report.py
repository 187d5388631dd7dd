"""Report tables (R1-R6) and cell-text sanitising."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_strip, latin1_cell  # noqa: F401  (re-exported)

NAME_WIDTH = 40     # fixed value: feature names are cut to 40 characters


def default_title(dataset: str) -> str:
    return f"{dataset} — Analytical Report"


def report_profile(raw: DataFrame, clean: DataFrame, health: DataFrame) -> DataFrame:
    """Raw rows, clean rows, clean features, health score (one row).

    The two row counts are global aggregates; combined by union + max."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows")).select(
        "raw_rows", F.lit(None).cast("bigint").alias("clean_rows"))
    b = clean.agg(F.count(F.lit(1)).alias("clean_rows")).select(
        F.lit(None).cast("bigint").alias("raw_rows"), "clean_rows")
    h = health.select(F.col("health_score")).first()
    return a.unionByName(b).agg(F.max("raw_rows").alias("raw_rows"), F.max("clean_rows").alias("clean_rows")) \
        .select("raw_rows", "clean_rows", F.lit(len(clean.columns)).alias("features"),
                F.lit(h["health_score"] if h else None).cast("double").alias("health_score"))


def report_cleaning(decisions: DataFrame) -> DataFrame:
    """R2: (action, justification)."""
    return decisions.select(F.col("column_action").alias("action"), F.col("justification"))


def report_leaderboard(board: DataFrame, task: str) -> DataFrame:
    """(algorithm, primary metric to 4 decimals; a missing value is 0)."""
    metric = "f1" if task == "classification" else "rmse"
    return board.orderBy("rank").select(
        F.col("model").alias("algorithm"),
        F.format_number(F.coalesce(F.col(metric), F.lit(0.0)), 4).alias("score"))


def report_importance(importance: DataFrame) -> DataFrame:
    """Feature names cut to 40 characters."""
    return importance.select("rank", F.substring("feature", 1, NAME_WIDTH).alias("feature"), "importance")


def audit_appendix(audit: DataFrame) -> DataFrame:
    """The audit log with non-ASCII characters removed from every text cell."""
    return audit.select(*[ascii_strip(F.col(c)).alias(c) if t == "string" else F.col(c)
                          for c, t in audit.dtypes])


def cell(c: Column, width: int) -> Column:
    """A table cell: non-Latin-1 -> '?', cut to int(width / 2) characters."""
    return latin1_cell(c, width)
