"""End-to-end automatic run (E1): load -> column filter -> health -> profile +
target -> clean -> re-profile -> transform, with an audit log; optional sweep.

Every step is a lazy DataFrame plan; the fit jobs return one small row per
column. ``PipelineResult`` keeps the three dataset versions as DataFrames and
the logs as small lists, exposed as DataFrames.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import keep

from ..functions.types import CATEGORICAL, NUMERIC, normalize_missing
from ..operators import clean as CL
from ..operators import features as FT
from ..operators import ml as ML
from ..operators import profile as P
from ..operators import select as SL
from ..operators import target as TG
from ..sources.sinks import write_table

# Audit step names and texts (status is plain text).
OK = "Success"


@dataclass
class PipelineResult:
    raw: DataFrame
    filtered: DataFrame
    clean: DataFrame
    transformed: DataFrame
    dropped: dict[str, str]
    health_score: float
    profile: DataFrame
    clean_profile: DataFrame
    context: dict
    cleaning: CL.CleanResult
    audit_rows: list[tuple] = field(default_factory=list)
    ml: ML.SweepResult | None = None
    cached: list = field(default_factory=list)

    def release(self) -> None:
        """Unpersist the frames cached during the run (frequency table, dedup)."""
        for c in self.cached:
            c.unpersist()
        self.cleaning.release()

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    def decisions(self) -> DataFrame:
        """(phase, column_action, justification): ingestion drops, cleaning log,
        duplicate removal."""
        rows = [("Ingestion", f"Drop '{c}'", r) for c, r in self.dropped.items()]
        rows += [tuple(r) for r in self.cleaning.decisions(self.spark).collect()]
        return self.spark.createDataFrame(rows, "phase string, column_action string, justification string")

    def audit(self) -> DataFrame:
        return self.spark.createDataFrame(self.audit_rows, "step_no int, step string, detail string, status string")

    def add_sweep(self, target: str | None = None) -> ML.SweepResult:
        """Run the model sweep on the transformed data and append its audit rows once."""
        target = target or self.context["target_variable"]
        res = ML.sweep(self.transformed, target)
        self.ml = res
        if "Train/Test Split" not in [r[1] for r in self.audit_rows]:
            n = len(self.audit_rows) + 1
            names = [r["model"] for r in res.leaderboard.orderBy("rank").collect()]
            self.audit_rows.append((n, "Train/Test Split",
                                    "Dataset split 80% training / 20% test (content-hash split)", OK))
            self.audit_rows.append((n + 1, "Algorithm Sweep",
                                    f"{len(names)} model(s) trained: {', '.join(names)}", OK))
            self.audit_rows.append((n + 2, "Best Model Selection",
                                    f"Best model: '{res.best_model_name or 'N/A'}' | {res.metric_name}: "
                                    f"{res.best_metric_value:.4f}", OK))
            k = res.feature_importance.count()
            if k:
                self.audit_rows.append((n + 3, "Feature Importance Extraction",
                                        f"{k} features ranked by contribution to '{target}'", OK))
        return res

    def write(self, path: str) -> None:
        """S3: clean / transformed data and the logs as parquet tables."""
        write_table(self.clean, f"{path}/clean")
        write_table(self.transformed, f"{path}/transformed")
        write_table(self.decisions(), f"{path}/decisions")
        write_table(self.audit(), f"{path}/audit")
        write_table(self.clean_profile, f"{path}/profile")


def run_pipeline(df: DataFrame, target: str | None = None, order_by=None, source: str = "table",
                 null_text: str = "keep", quantiles: str = "exact") -> PipelineResult:
    audit = []
    df = normalize_missing(df, exact=True)
    # one frequency table of the raw input feeds the filter, the health score,
    # the profile and the target choice; the filter only drops columns, so the
    # filtered table is a subset of it (positions renumbered)
    vf_raw = keep(P.frequency_table(df, text="hash"))
    raw_summary = P.column_summary(df, vf_raw)
    raw_rows = raw_summary.collect()                      # one row per column
    rows = raw_rows[0]["n_rows"] if raw_rows else 0
    audit.append((1, "Data Received", f"'{source}' received (Spark DataFrame)", OK))
    audit.append((2, "Format Parsing", f"Table read ({rows} rows × {len(df.columns)} cols)", OK))
    ff = SL.fit_feature_filter(df, raw_summary)
    # an explicit order key is kept for ordering even when it looks like an ID
    for k in ([order_by] if isinstance(order_by, str) else list(order_by or [])):
        ff.drops.pop(k, None)
    filtered = ff.transform(df)
    kept = {c: i for i, c in enumerate(filtered.columns)}
    # old position -> new position by array index (O(1) per row)
    new_pos = F.array(*[F.lit(kept.get(c, -1)) for c in df.columns])
    vf = (vf_raw.withColumn("position", F.element_at(new_pos, F.col("position") + 1).cast("int"))
          .where(F.col("position") >= 0)) if kept else vf_raw.limit(0)
    audit.append((3, "Primary Key & Zero-Variance Filter",
                  f"{len(ff.drops)} uninformative column(s) removed (ID fields, zero-variance)", OK))
    health = P.health_components(filtered, vf).first()["health_score"]
    audit.append((4, "Dataset Health Scoring", f"Health score computed: {health}/100", OK))
    summary = P.column_summary(filtered, vf).collect()   # one row per column
    profile = P.profile_schema(filtered, vf)
    audit.append((5, "Schema Inference",
                  f"Column types, null %, and cardinality computed for {len(summary)} features", OK))
    tgt = target or TG.suggest_target(filtered.columns)
    info = {r["column"]: r for r in summary}
    regression = info.get(tgt) is not None and info[tgt]["dtype"] == NUMERIC and info[tgt]["cardinality"] > 10
    context = {"industry": TG.INDUSTRY, "target_variable": tgt,
               "evaluation_metric": TG.METRIC_REGRESSION if regression else TG.METRIC_CLASSIFICATION,
               "business_summary": TG.SUMMARY_REGRESSION if regression else TG.SUMMARY_CLASSIFICATION,
               "suggested_queries": [f"Show distribution of {tgt}.",
                                     f"How does {tgt} vary across different groups?"]}
    audit.append((6, "Domain Context Identification",
                  f"Industry: '{context['industry']}', Target: '{tgt}' — via Heuristic Fallback", OK))
    audit.append((7, "Column Name Standardization",
                  "All column names lowercased, spaces → underscores, special chars removed", OK))
    audit.append((8, "Data Type Fixing & Text Cleaning",
                  "String columns stripped, lowercased; date patterns auto-converted to datetime", OK))
    cres = CL.clean(filtered, order_by=order_by, null_text=null_text, quantiles=quantiles)
    audit.append((9, "Duplicate Row Removal",
                  f"{cres.duplicates_removed} duplicate row(s) detected and removed", OK))
    imputed = [c for c, m in cres.impute.methods.items() if m in ("median", "mean", "mode", "ffill_bfill")]
    dropped = [c for c, m in cres.impute.methods.items() if m == "drop"]
    audit.append((10, "Missing Value Imputation",
                   f"{len(imputed)} column(s) imputed (Mean/Median/Mode), {len(dropped)} column(s) dropped (>30% missing)", OK))
    audit.append((11, "Outlier Winsorization (IQR)",
                   "IQR-based clipping applied on all numeric columns; domain-specific ranges enforced (age, salary, price, amount)", OK))
    # the cleaned frame feeds the re-profile, every transform fit and the output:
    # persist it once (its plan holds the dedup and, with an order key, the fill)
    clean_df = keep(cres.df)
    vf_clean = keep(P.frequency_table(clean_df, text="hash"))
    clean_summary = P.column_summary(clean_df, vf_clean).collect()
    clean_rows = clean_summary[0]["n_rows"] if clean_summary else 0
    audit.append((12, "Post-Cleaning Schema Re-inference",
                  f"Updated schema inferred on cleaned dataset ({clean_rows} rows × {len(clean_df.columns)} cols)", OK))
    # target name matched case-insensitively after cleaning
    cols_lower = {c.lower(): c for c in clean_df.columns}
    true_target = cols_lower.get(tgt.lower(), CL.clean_name(tgt))
    if true_target in clean_df.columns:
        context["target_variable"] = true_target
    plan = FT.fit_transform_plan(clean_df, clean_summary,
                                 target=true_target if true_target in clean_df.columns else None)
    transformed = plan.transform(clean_df)
    n_cat = sum(1 for r in clean_summary if r["dtype"] == CATEGORICAL)
    n_num = sum(1 for r in clean_summary if r["dtype"] == NUMERIC and r["column"] != true_target)
    audit.append((13, "Categorical Encoding (One-Hot / Label)", f"{n_cat} categorical column(s) encoded", OK))
    audit.append((14, "Numeric Feature Scaling", f"{n_num} numeric column(s) standardized (Z-score)", OK))
    audit.append((15, "Dataset Ready for ML",
                   f"Final transformed dataset: {clean_rows} rows × {len(transformed.columns)} features", OK))
    return PipelineResult(df, filtered, clean_df, transformed, dict(ff.drops), float(health), profile,
                          P.profile_schema(clean_df, vf_clean), context, cres, audit,
                          cached=[vf_raw, vf_clean, clean_df])
