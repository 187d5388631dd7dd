"""Helpers that write the DuckDB oracle SQL for the registered queries.

The SQL is independent of the Spark implementation: it recomputes every
statistic from the raw rows with plain aggregates. Column lists are fixed data
(the driver table schemas of TESTDATA.md / FIXTURES.md).
"""
from __future__ import annotations

# Logical types of the columns of the tables and variants used by the
# registered queries (numeric / datetime / categorical, as in the profile).
N, D, C = "numeric", "datetime", "categorical"
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "customer": [("c_custkey", N), ("c_name", C), ("c_nationkey", N), ("c_acctbal", N),
                 ("c_mktsegment", C)],
    "orders": [("o_orderkey", N), ("o_custkey", N), ("o_orderstatus", C), ("o_totalprice", N),
               ("o_orderdate", D), ("o_orderpriority", C)],
    "lineitem": [("l_orderkey", N), ("l_partkey", N), ("l_suppkey", N), ("l_linenumber", N),
                 ("l_quantity", N), ("l_extendedprice", N), ("l_discount", N), ("l_tax", N),
                 ("l_returnflag", C), ("l_linestatus", C), ("l_shipdate", D)],
    "events": [("event_id", N), ("ts", D), ("user_id", N), ("event_type", C), ("value", N),
               ("props", C)],
    "part": [("p_partkey", N), ("p_name", C), ("p_brand", C), ("p_type", C), ("p_size", N),
             ("p_retailprice", N)],
    "documents": [("doc_id", N), ("text", C), ("lang", C), ("source", C), ("n_chars", N)],
    "labels": [("doc_id", N), ("quality", N), ("toxic", N)],
    "supplier": [("s_suppkey", N), ("s_name", C), ("s_nationkey", N), ("s_acctbal", N)],
}
SCHEMAS["customer_nulls"] = SCHEMAS["customer"]
SCHEMAS["events_nulls"] = SCHEMAS["events"]
SCHEMAS["events_dups"] = SCHEMAS["events"]
SCHEMAS["orders_sparse"] = SCHEMAS["orders"]
SCHEMAS["orders_constant"] = SCHEMAS["orders"] + [("channel", C)]
SCHEMAS["orders_dominant"] = SCHEMAS["orders"] + [("flag", C)]
SCHEMAS["customer_negative"] = [("c_custkey", N), ("c_name", C), ("c_nationkey", N),
                                ("amount", N), ("c_mktsegment", C)]
SCHEMAS["orders_decimal"] = [("big_id", N), ("cust", N), ("o_orderstatus", C)]
SCHEMAS["orders_text"] = [(c, C) for c, _ in SCHEMAS["orders"]]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def cols(table: str) -> list[tuple[str, str]]:
    return SCHEMAS[table]


def profile_sql(src: str, table: str) -> str:
    parts = []
    for i, (c, t) in enumerate(cols(table)):
        c = q(c)
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c[1:-1]}' AS \"column\", '{t}' AS dtype, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"CAST(CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) - count({c})) * 100.0 / count(*) END AS DOUBLE) AS null_percentage, "
            f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS cardinality "
            f"FROM {src}")
    return union_all(parts)


def null_cells_sql(src: str, table: str) -> str:
    """total NULL cells of a table."""
    return " + ".join(f"(count(*) - count({q(c)}))" for c, _ in cols(table))


def dominant_sql(src: str, table: str) -> str:
    """number of columns whose top non-null value exceeds 95 % of non-null rows."""
    parts = []
    for c, _ in cols(table):
        c = q(c)
        parts.append(
            f"(SELECT CASE WHEN max(cnt) * 100 > 95 * sum(cnt) THEN 1 ELSE 0 END "
            f"FROM (SELECT count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}))")
    return "(" + " + ".join(parts) + ")"


def health_sql(src: str, table: str, outer: str | None = None) -> str:
    """null %, duplicate %, dominant % and the score, as one row."""
    k = len(cols(table))
    return f"""
, base AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST({null_cells_sql(src, table)} AS DOUBLE) AS nulls FROM {src}
), d AS (SELECT CAST(count(*) AS DOUBLE) AS groups FROM (SELECT DISTINCT * FROM {src})),
parts AS (
  SELECT nulls / (n * {k}) * 100.0 AS null_cell_pct,
         (n - groups) / n * 100.0 AS duplicate_row_pct,
         CAST({dominant_sql(src, table)} AS DOUBLE) / {k} * 100.0 AS dominant_pct,
         CAST({dominant_sql(src, table)} AS BIGINT) AS dominant_columns
  FROM base, d
)
SELECT {outer or "*"} FROM (
SELECT null_cell_pct, duplicate_row_pct, dominant_pct, dominant_columns,
       round(greatest(0.0, least(100.0, 100.0 - (null_cell_pct * 0.5 + duplicate_row_pct * 0.3 + dominant_pct * 0.2))), 2) AS health_score
FROM parts) h"""


def is_id_name(name: str) -> bool:
    low = name.lower()
    return low in ("id", "uuid", "index") or low.endswith("_id") or low.endswith(" id")


def rules_sql(src: str, table: str, outer: str = "SELECT *") -> str:
    """(position, column, zero_variance, id_named, unique_text, rule, reason)."""
    parts = []
    for i, (c, t) in enumerate(cols(table)):
        qc = q(c)
        is_text = "TRUE" if t == C else "FALSE"
        is_id = "TRUE" if is_id_name(c) else "FALSE"
        parts.append(f"""
SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column",
  n > 0 AND card <= 1 AS zero_variance,
  n > 0 AND {is_id} AND dn > n * 0.5 AS id_named,
  n > 0 AND {is_text} AND dn = n AS unique_text
FROM (SELECT count(*) AS n, count(DISTINCT {qc}) AS dn,
             count(DISTINCT {qc}) + max(CASE WHEN {qc} IS NULL THEN 1 ELSE 0 END) AS card FROM {src})""")
    body = union_all(parts)
    return f"""
, flags AS ({body})
{outer} FROM (SELECT position, "column", zero_variance, id_named, unique_text,
  CASE WHEN zero_variance THEN 'zero_variance' WHEN id_named THEN 'id_named'
       WHEN unique_text THEN 'unique_text' END AS rule,
  CASE WHEN zero_variance THEN 'Zero-variance (All values are identical or completely missing).'
       WHEN id_named THEN 'Detected as a primary key/ID by name (''' || "column" || ''').'
       WHEN unique_text THEN '100% unique string values (Likely a primary key or arbitrary identifier).' END AS reason
FROM flags) r"""
