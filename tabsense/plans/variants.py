"""Deterministic null/dirt injection over the driver tables (FIXTURES.md §2).

Each variant is a pure projection (or a union with a copy of some rows) of a
whole table, written once as SQL text that both Spark SQL and DuckDB accept:
the Spark side runs it through ``spark.sql`` over the parquet-backed views and
the oracle side inlines the same text as a CTE. The modulo expressions decide
*which* values become NULL/duplicated; no row is ever filtered away.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The variant definitions of FIXTURES.md §2.
VARIANTS: dict[str, str] = {
    "customer_nulls": (
        "SELECT c_custkey, c_name, c_nationkey, "
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment "
        "FROM customer"),
    "customer_nan": (
        "SELECT c_custkey, c_name, c_nationkey, "
        "CASE WHEN c_custkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END AS c_acctbal, "
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment "
        "FROM customer"),
    "events_nulls": (
        "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts, user_id, "
        "event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, props "
        "FROM events"),
    "orders_sparse": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, "
        "CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE o_totalprice END AS o_totalprice, "
        "o_orderdate, o_orderpriority FROM orders"),
    "orders_constant": "SELECT *, 'x' AS channel FROM orders",
    "orders_dominant": (
        "SELECT *, CASE WHEN o_orderkey % 25 = 0 THEN 'b' ELSE 'a' END AS flag FROM orders"),
    # keys that agree in their first 19 digits, beyond what a double tells apart
    "orders_decimal": (
        "SELECT CAST(o_orderkey AS DECIMAL(20,0)) + CAST('90071992547409930000000' AS DECIMAL(30,0)) AS big_id, "
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS DECIMAL(20,2)) END AS cust, "
        "o_orderstatus FROM orders"),
    "orders_text": (
        "SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, "
        "o_orderstatus, CAST(o_totalprice AS STRING) AS o_totalprice, "
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate, o_orderpriority FROM orders"),
    "customer_negative": (
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal AS amount, c_mktsegment FROM customer"),
    "events_dups": "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0",
    "predictions": (
        "SELECT doc_id, toxic AS label, "
        "CASE WHEN doc_id % 4 = 0 THEN 1 - toxic ELSE toxic END AS prediction, "
        "CAST(doc_id % 100 AS DOUBLE) / 100.0 AS score FROM labels"),
    "rule_predictions": (
        "SELECT 0 AS model_no, 'Flip every 4th' AS model, doc_id, toxic AS label, "
        "CASE WHEN doc_id % 4 = 0 THEN 1 - toxic ELSE toxic END AS prediction FROM labels "
        "UNION ALL SELECT 1, 'Quality as toxic', doc_id, toxic, quality FROM labels "
        "UNION ALL SELECT 2, 'Always zero', doc_id, toxic, 0 FROM labels "
        "UNION ALL SELECT 3, 'Exact', doc_id, toxic, toxic FROM labels "
        "UNION ALL SELECT 4, 'Exact copy', doc_id, toxic, toxic FROM labels"),
    "predictions_reg": (
        "SELECT o_orderkey, o_totalprice AS label, o_totalprice * 0.9 + 1000 AS prediction "
        "FROM orders"),
}


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or an injected variant, as a lazy DataFrame."""
    if name in VARIANTS:
        register_tables(spark, sf_dir)
        return spark.sql(VARIANTS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """``WITH`` clause defining the named variants for the DuckDB oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VARIANTS[n]})" for n in names) + " "
