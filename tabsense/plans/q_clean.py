"""Registered queries: cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators import clean as CL
from ..operators import features as FT
from ..operators import profile as P
from . import oracle as O
from .catalog import r6, r6sql, register, with_
from .variants import table

WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def norm_sql(x: str) -> str:
    return f"lower(trim({x}, {WS}))"


# A1 ---------------------------------------------------------------------------
_MESSY = [" Cust Key ", "Name (full)", "Nation KEY", "Acct Bal €", "***"]


def _messy_customer(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                          "c_mktsegment").toDF(*_MESSY)


register("standardize_names",
         "SELECT c_custkey AS cust_key, c_name AS name_full, c_nationkey AS nation_key, "
         "c_acctbal AS acct_bal_, c_mktsegment AS col_4 FROM customer")(
    lambda s, d: CL.standardize_columns(_messy_customer(s, d)))

# A2/A3 ------------------------------------------------------------------------
_FMT = {"yyyy-MM-dd": "%Y-%m-%d", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S",
        "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S", "MM/dd/yyyy": "%m/%d/%Y",
        "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM-dd HH:mm:ss.SSS": "%Y-%m-%d %H:%M:%S.%g",
        "yyyy-MM-dd'T'HH:mm:ss.SSS": "%Y-%m-%dT%H:%M:%S.%g",
        "yyyy-MM-dd HH:mm:ss.SSSSSS": "%Y-%m-%d %H:%M:%S.%f",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": "%Y-%m-%dT%H:%M:%S.%f"}


def _date_detect_sql(src):
    parts = []
    for c, _ in O.cols(src):
        qc = O.q(c)
        fmt = "CAST(NULL AS VARCHAR)"
        for sf in reversed(_FMT):
            fmt = (f"CASE WHEN count(try_strptime({qc}, '{_FMT[sf]}')) = count({qc}) "
                   f"THEN '{sf.replace(chr(39), chr(39) * 2)}' ELSE {fmt} END")
        parts.append(
            f"SELECT '{c}' AS \"column\", count(CASE WHEN regexp_matches({qc}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}|^\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN 1 END) AS hint_rows, "
            f"count({qc}) AS nonnull, {fmt} AS fmt FROM {src}")
    return (with_(src) + "SELECT \"column\", hint_rows, nonnull, CASE WHEN hint_rows > 0 THEN fmt END AS format FROM ("
            + O.union_all(parts) + ") x")


register("date_detect", _date_detect_sql("orders_text"))(
    lambda s, d: CL.date_hint_counts(table(s, d, "orders_text")))


def _date_cast(s, d):
    df = table(s, d, "orders_text")
    return CL.cast_dates(df, CL.detect_dates(df))


register("date_cast", with_("orders_text") +
         "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
         "CAST(strptime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS o_orderdate, o_orderpriority "
         "FROM orders_text")(_date_cast)

# A4/A5 ------------------------------------------------------------------------
register("text_normalize",
         f"SELECT doc_id, {norm_sql('text')} AS text, {norm_sql('lang')} AS lang, "
         f"{norm_sql('source')} AS source, n_chars FROM documents")(
    lambda s, d: CL.clean_text(table(s, d, "documents")))

register("text_null_literal", with_("customer_nulls") +
         f"SELECT c_custkey, {norm_sql('c_name')} AS c_name, c_nationkey, c_acctbal, "
         + norm_sql("coalesce(c_mktsegment, 'nan')") + " AS c_mktsegment FROM customer_nulls")(
    lambda s, d: CL.clean_text(table(s, d, "customer_nulls"), null_text="literal"))

# A6 ---------------------------------------------------------------------------
register("dedup_rows", with_("events_dups") + "SELECT DISTINCT * FROM events_dups")(
    lambda s, d: CL.remove_duplicates(table(s, d, "events_dups"))[0])

register("dedup_count", with_("events_dups") +
         "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM events_dups)) AS n_distinct, "
         "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_dups)) AS removed FROM events_dups")(
    lambda s, d: P.distinct_row_count(table(s, d, "events_dups"))
    .withColumn("removed", F.col("n_rows") - F.col("n_distinct")))


# A7-A10 decisions ---------------------------------------------------------------
def _g1_sql(x, src):
    return (f"(SELECT avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5) FROM "
            f"(SELECT CAST({x} AS DOUBLE) AS v, avg(CAST({x} AS DOUBLE)) OVER () AS m FROM {src}) "
            f"WHERE v IS NOT NULL)")


def _decisions_sql(src, ordered=True):
    parts = []
    for c, t in O.cols(src):
        qc = O.q(c)
        num = t == O.N
        g1 = (f"CASE WHEN var_pop({qc}) = 0 THEN NULL ELSE {_g1_sql(qc, src)} END") if num else "NULL"
        meth = ("CASE WHEN z = 0 THEN 'none' WHEN pct > 30 THEN 'drop' "
                + ("WHEN g1 IS NULL OR abs(g1) > 0.5 THEN 'median' ELSE 'mean' END" if num else
                   ("ELSE 'ffill_bfill' END" if (t == O.D and ordered) else
                    ("ELSE 'none' END" if t == O.D else "ELSE 'mode' END"))))
        parts.append(
            f"SELECT '{c}' AS \"column\", z AS null_count, pct AS null_percentage, {meth} AS method FROM ("
            f"SELECT count(*) - count({qc}) AS z, (count(*) - count({qc})) * 100.0 / count(*) AS pct, "
            f"{g1} AS g1 FROM {src})")
    return with_(src) + ("SELECT \"column\", null_count, " + r6sql("null_percentage")
                         + " AS null_percentage, method FROM (" + O.union_all(parts) + ") x")


register("drop_sparse_columns", _decisions_sql("orders_sparse"))(
    lambda s, d: r6(CL.impute_decisions(table(s, d, "orders_sparse"), order_by="o_orderkey")))
register("impute_decisions", _decisions_sql("events_nulls"))(
    lambda s, d: r6(CL.impute_decisions(table(s, d, "events_nulls"), order_by="event_id")))


def _impute_one(src, key, column, order=None):
    def run(s, d):
        df = table(s, d, src)
        plan = CL.fit_impute(df, order)
        return r6(plan.transform(df).select(key, column))
    return run


def _impute_num_sql(src, key, c):
    return (with_(src) + f", st AS (SELECT avg({c}) AS m, median({c}) AS med, "
            f"CASE WHEN var_pop({c}) = 0 THEN NULL ELSE {_g1_sql(c, src)} END AS g1 FROM {src}) "
            f"SELECT {key}, {r6sql(f'coalesce(CAST({c} AS DOUBLE), CASE WHEN g1 IS NULL OR abs(g1) > 0.5 THEN med ELSE m END)')} "
            f"AS {c} FROM {src}, st")


register("impute_median", _impute_num_sql("events_nulls", "event_id", "value"))(
    _impute_one("events_nulls", "event_id", "value"))
register("impute_mean", _impute_num_sql("customer_nulls", "c_custkey", "c_acctbal"))(
    _impute_one("customer_nulls", "c_custkey", "c_acctbal"))
register("impute_mode", with_("customer_nulls") +
         "SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM customer_nulls "
         "WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) "
         "AS c_mktsegment FROM customer_nulls")(
    _impute_one("customer_nulls", "c_custkey", "c_mktsegment"))

_FILL_SQL = ("coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {k} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
             "first_value({c} IGNORE NULLS) OVER (ORDER BY {k} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
register("ffill_bfill", with_("events_nulls") +
         f"SELECT event_id, {_FILL_SQL.format(c='ts', k='event_id')} AS ts, "
         f"{r6sql(_FILL_SQL.format(c='value', k='event_id'))} AS value, user_id, event_type, props FROM events_nulls")(
    lambda s, d: r6(CL.fill_forward_backward(table(s, d, "events_nulls"), ["ts", "value"], "event_id")))
# a text key whose values share a long prefix, and a hot first key
_TWO = "last_value(value IGNORE NULLS) OVER (ORDER BY event_type, props, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_TWO_BACK = "first_value(value IGNORE NULLS) OVER (ORDER BY event_type, props, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
register("ffill_text_keys", with_("events_nulls") +
         f"SELECT event_id, {r6sql(f'coalesce({_TWO}, {_TWO_BACK})')} AS value FROM events_nulls")(
    lambda s, d: r6(CL.fill_forward_backward(table(s, d, "events_nulls"), ["value"],
                                             ["event_type", "props", "event_id"]).select("event_id", "value")))


# A11/A12 ----------------------------------------------------------------------
def _winsor_expr(x, clip):
    v = f"CAST({x} AS DOUBLE)"
    if clip:
        v = f"CASE WHEN {v} < 0 THEN 0.0 ELSE {v} END"
    return v


def _winsor_sql(src, rest, columns, clip_cols=()):
    qs = ", ".join(f"quantile_cont({_winsor_expr(c, c in clip_cols)}, 0.25) AS a_{c}, "
                   f"quantile_cont({_winsor_expr(c, c in clip_cols)}, 0.75) AS b_{c}" for c in columns)
    outs = []
    for c in columns:
        v = _winsor_expr(c, c in clip_cols)
        lo, hi = f"(a_{c} - 1.5 * (b_{c} - a_{c}))", f"(b_{c} + 1.5 * (b_{c} - a_{c}))"
        outs.append(r6sql(f"CASE WHEN {v} < {lo} THEN {lo} WHEN {v} > {hi} THEN {hi} ELSE {v} END") + f" AS {c}")
    return with_(src) + f", qq AS (SELECT {qs} FROM {src}) SELECT {rest}, {', '.join(outs)} FROM {src}, qq"


register("winsorize_iqr", _winsor_sql("events", "ts, event_type, props", ["event_id", "user_id", "value"]))(
    lambda s, d: r6(CL.winsorize(table(s, d, "events"))))
register("clip_nonnegative", _winsor_sql("customer_negative", "c_name, c_mktsegment",
                                         ["c_custkey", "c_nationkey", "amount"], ("amount",)))(
    lambda s, d: r6(CL.winsorize(table(s, d, "customer_negative"))))

# NaN is missing: the same results as with NULL in its place
register("nan_impute", _impute_num_sql("customer_nulls", "c_custkey", "c_acctbal"))(
    _impute_one("customer_nan", "c_custkey", "c_acctbal"))
register("nan_winsorize", _winsor_sql("customer_nulls", "c_name, c_mktsegment",
                                      ["c_custkey", "c_nationkey", "c_acctbal"]))(
    lambda s, d: r6(CL.winsorize(table(s, d, "customer_nan"))))
register("nan_schema_profile", with_("customer_nulls") +
         "SELECT count(*) - count(c_acctbal) AS acct, count(*) - count(c_mktsegment) AS segment FROM customer_nulls")(
    lambda s, d: P.profile_schema(table(s, d, "customer_nan")).agg(
        F.max(F.when(F.col("column") == "c_acctbal", F.col("null_count"))).alias("acct"),
        F.max(F.when(F.col("column") == "c_mktsegment", F.col("null_count"))).alias("segment")))
register("nan_zscore", with_("customer_nulls") +
         "SELECT c_custkey, " + r6sql("(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()")
         + " AS z FROM customer_nulls")(
    lambda s, d: r6(FT.zscore(table(s, d, "customer_nan"), ["c_acctbal"]).select(
        "c_custkey", F.nanvl("c_acctbal", F.lit(None).cast("double")).alias("z"))))
# A7 through the plan that clean runs: the sparse column is gone, the rest is as it was
register("drop_sparse_frame", with_("orders_sparse") +
         "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders_sparse")(
    lambda s, d: CL.impute(table(s, d, "orders_sparse"), order_by="o_orderkey")[0])


def _bounds_sql(src, columns, clip_cols=()):
    parts = []
    for c in columns:
        v = _winsor_expr(c, c in clip_cols)
        parts.append(f"SELECT '{c}' AS \"column\", {'TRUE' if c in clip_cols else 'FALSE'} AS clipped, "
                     f"{r6sql(f'quantile_cont({v}, 0.25) - 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))')} AS lower, "
                     f"{r6sql(f'quantile_cont({v}, 0.75) + 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))')} AS upper "
                     f"FROM {src}")
    return with_(src) + O.union_all(parts)


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]
register("outlier_bounds", _bounds_sql("lineitem", _LI_NUM, ("l_extendedprice",)))(
    lambda s, d: r6(CL.outlier_bounds(table(s, d, "lineitem"))))


# A13/A15 ----------------------------------------------------------------------
def _clean_events(s, d):
    return CL.clean(table(s, d, "events_nulls"), order_by="event_id")


_W3 = ("event_id", "user_id", "value")
_CLAMP = ("CASE WHEN {c} < (a_{c} - 1.5 * (b_{c} - a_{c})) THEN (a_{c} - 1.5 * (b_{c} - a_{c})) "
          "WHEN {c} > (b_{c} + 1.5 * (b_{c} - a_{c})) THEN (b_{c} + 1.5 * (b_{c} - a_{c})) ELSE {c} END")
_CLEAN_SQL = (
    with_("events_nulls")
    + f", t1 AS (SELECT event_id, ts, user_id, {norm_sql('event_type')} AS event_type, value, "
      f"{norm_sql('props')} AS props FROM events_nulls), "
    + "t2 AS (SELECT DISTINCT * FROM t1), "
    + f"st AS (SELECT avg(value) AS m, median(value) AS med, CASE WHEN var_pop(value) = 0 THEN NULL "
      f"ELSE {_g1_sql('value', 't2')} END AS g1 FROM t2), "
    + f"t3 AS (SELECT CAST(event_id AS DOUBLE) AS event_id, {_FILL_SQL.format(c='ts', k='event_id')} AS ts, "
      "CAST(user_id AS DOUBLE) AS user_id, event_type, "
      "coalesce(value, CASE WHEN g1 IS NULL OR abs(g1) > 0.5 THEN med ELSE m END) AS value, props FROM t2, st), "
    + "qq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}"
                                   for c in _W3) + " FROM t3) "
    + "SELECT " + ", ".join(r6sql(_CLAMP.format(c=c)) + f" AS {c}" for c in _W3)
    + ", ts, event_type, props FROM t3, qq")
register("clean_full", _CLEAN_SQL)(lambda s, d: r6(_clean_events(s, d).df))

_PCT = "printf('%.1f', (count(*) - count({c})) * 100.0 / count(*))"
_G1V = "(SELECT CASE WHEN var_pop(value) = 0 THEN NULL ELSE " + _g1_sql("value", "events_nulls") + " END FROM events_nulls)"
# The decision texts, as in clean.py.
_DECISION_SQL = (
    with_("events_nulls")
    + "SELECT 'Cleaning' AS phase, 'Modify/Drop ''ts''' AS column_action, 'Imputed ' || "
    + _PCT.format(c="ts")
    + " || '% missing values using Forward/Backward Fill to maintain temporal continuity.' AS justification "
      "FROM events_nulls UNION ALL SELECT 'Cleaning', 'Modify/Drop ''value''', 'Imputed ' || "
    + _PCT.format(c="value")
    + f" || CASE WHEN {_G1V} IS NULL OR abs({_G1V}) > 0.5 THEN "
      "'% missing values using the Median. Justification: Distribution is highly skewed, making median more robust than mean.' "
      "ELSE '% missing values using the Mean. Justification: Distribution is relatively normal.' END FROM events_nulls")
register("decision_log", _DECISION_SQL)(lambda s, d: _clean_events(s, d).decisions(s))
