"""tabsense: automatic profiling, cleaning, feature preparation, EDA and model
sweeps over Spark DataFrames.

The most used entry points are re-exported here; every operator lives in
``tabsense.operators`` (profile, select, clean, features, correlate, charts,
query, target, ml, report), sources in ``tabsense.sources`` and the
end-to-end run in ``tabsense.plans.automatic``.
"""
__version__ = "0.1.0"

from .operators.charts import chart_data, resolve_chart  # noqa: E402
from .operators.clean import clean, fill_forward_backward, remove_duplicates, winsorize  # noqa: E402
from .operators.correlate import correlation_matrix, strong_pairs  # noqa: E402
from .operators.features import transform  # noqa: E402
from .operators.ml import classification_metrics, regression_metrics, sweep  # noqa: E402
from .operators.profile import (column_stats, describe_columns, health_score,  # noqa: E402
                                profile_schema, top_values)
from .operators.query import QuerySpec, run_query, run_sql  # noqa: E402
from .operators.select import filter_features  # noqa: E402
from .plans.automatic import PipelineResult, run_pipeline  # noqa: E402
from .sources.csv import read_csv_auto  # noqa: E402

__all__ = [
    "PipelineResult", "QuerySpec", "chart_data", "classification_metrics", "clean", "column_stats",
    "correlation_matrix", "describe_columns", "fill_forward_backward", "filter_features",
    "health_score", "profile_schema", "read_csv_auto", "regression_metrics", "remove_duplicates",
    "resolve_chart", "run_pipeline", "run_query", "run_sql", "strong_pairs", "sweep", "top_values",
    "transform", "winsorize",
]
