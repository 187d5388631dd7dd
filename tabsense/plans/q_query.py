"""Registered queries: ad-hoc query specs (F5, Q1-Q9) and target/task detection."""
from __future__ import annotations

import datetime as _dt

from ..operators import profile as P
from ..operators import query as QY
from ..operators import target as TG
from .catalog import r6, r6sql, register, with_
from .variants import table


def _spec(src, spec):
    return lambda s, d: r6(QY.run_query(table(s, d, src), QY.QuerySpec(**spec)))


register("query_filter", "SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")(
    _spec("orders", {"filter": "o_totalprice > 200000 AND o_orderstatus = 'F'"}))

register("query_project", "SELECT o_orderkey, " + r6sql("o_totalprice * 2") + " AS double_price FROM orders")(
    _spec("orders", {"select": ["o_orderkey", "o_totalprice * 2 AS double_price"]}))

_GB = [["l_quantity", "sum", "sum_qty"], ["l_extendedprice", "mean", "avg_price"], ["*", "count", "n"],
       ["l_discount", "min", "min_disc"], ["l_discount", "max", "max_disc"],
       ["l_orderkey", "nunique", "n_orders"], ["l_discount", "median", "median_disc"],
       ["l_tax", "std", "std_tax"]]
register("query_groupby",
         "SELECT l_returnflag, l_linestatus, " + r6sql("sum(l_quantity)") + " AS sum_qty, "
         + r6sql("avg(l_extendedprice)") + " AS avg_price, count(*) AS n, " + r6sql("min(l_discount)")
         + " AS min_disc, " + r6sql("max(l_discount)") + " AS max_disc, count(DISTINCT l_orderkey) AS n_orders, "
         + r6sql("median(l_discount)") + " AS median_disc, " + r6sql("stddev_samp(l_tax)")
         + " AS std_tax FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    _spec("lineitem", {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": _GB}))

register("query_topk", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(
    _spec("orders", {"order_by": [["o_totalprice", "desc"], ["o_orderkey", "asc"]], "limit": 10}))

register("query_pivot",
         "SELECT l_returnflag, " + r6sql("sum(l_quantity) FILTER (WHERE l_linestatus = 'F')") + " AS \"F\", "
         + r6sql("sum(l_quantity) FILTER (WHERE l_linestatus = 'O')") + " AS \"O\" FROM lineitem GROUP BY l_returnflag")(
    _spec("lineitem", {"group_by": ["l_returnflag"], "pivot": {"column": "l_linestatus"},
                       "aggregations": [["l_quantity", "sum", "qty"]]}))

# minutes: the events leave many of them empty
register("query_resample",
         "WITH g AS (SELECT date_trunc('minute', ts) AS t, count(*) AS n, sum(user_id) AS users, avg(value) AS v "
         "FROM events GROUP BY 1), p AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 MINUTE)) AS ts FROM g) "
         "SELECT ts, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(users, 0) AS BIGINT) AS users, "
         + r6sql("v") + " AS avg_value FROM p LEFT JOIN g ON ts = t")(
    _spec("events", {"resample": {"time": "ts", "unit": "minute"},
                     "aggregations": [["*", "count", "n"], ["user_id", "sum", "users"],
                                      ["value", "mean", "avg_value"]]}))

register("query_melt",
         "SELECT o_orderkey, 'o_totalprice' AS variable, " + r6sql("o_totalprice") + " AS value FROM orders "
         "UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders")(
    _spec("orders", {"melt": {"ids": ["o_orderkey"], "values": ["o_totalprice", "o_custkey"]}}))
# text and numbers meet as text
register("query_melt_mixed",
         "SELECT o_orderkey, 'o_custkey' AS variable, CAST(o_custkey AS VARCHAR) AS value FROM orders "
         "UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders")(
    _spec("orders", {"melt": {"ids": ["o_orderkey"], "values": ["o_custkey", "o_orderstatus"]}}))
register("query_groupby_null_group", with_("customer_nulls") +
         "SELECT c_mktsegment, count(*) AS n, " + r6sql("median(c_acctbal)") + " AS med FROM customer_nulls GROUP BY 1")(
    _spec("customer_nulls", {"group_by": ["c_mktsegment"], "aggregations": [
        ["*", "count", "n"], ["c_acctbal", "median", "med"]]}))

register("query_sql", "SELECT o_orderstatus, count(*) AS n, " + r6sql("sum(o_totalprice)")
         + " AS total FROM orders GROUP BY o_orderstatus")(
    _spec("orders", {"sql": "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total "
                            "FROM {df} GROUP BY o_orderstatus"}))


# Q8 ---------------------------------------------------------------------------
def _suggested_distribution(s, d):
    df = table(s, d, "orders")
    target = TG.suggest_target(df.columns)
    return P.top_values(df, None, [target])


register("suggested_distribution",
         "SELECT 'o_orderstatus' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS INTEGER) AS rank, "
         "o_orderstatus AS value, count(*) AS cnt FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus")(
    _suggested_distribution)

register("suggested_groups",
         " UNION ALL ".join(f"SELECT '{c}' AS group_column, {c} AS group_value, count(*) AS n, "
                            + r6sql("avg(c_acctbal)") + f" AS mean_target FROM customer GROUP BY {c}"
                            for c in ("c_name", "c_mktsegment")))(
    lambda s, d: r6(QY.suggested_groups(table(s, d, "customer"), "c_acctbal")))


_LOGGED = [("Orders above 200000", QY.QuerySpec(filter="o_totalprice > 200000"),
            "SELECT count(*) FROM orders WHERE o_totalprice > 200000"),
           ("Orders by status", QY.QuerySpec(group_by=["o_orderstatus"]),
            "SELECT count(*) FROM (SELECT o_orderstatus FROM orders GROUP BY o_orderstatus)")]


def _query_log(s, d):
    df = table(s, d, "orders")
    log = QY.QueryLog()
    for q, spec, _ in _LOGGED:
        n = QY.run_query(df, spec).count()
        log.log(q, spec, f"{n} rows", at=_dt.datetime(2024, 1, 1))
    return log.to_frame(s)


register("query_log", " UNION ALL ".join(
    f"SELECT TIMESTAMP '2024-01-01 00:00:00' AS timestamp, '{q}' AS question, "
    f"'{spec.to_json().replace(chr(39), chr(39) * 2)}' AS spec, CAST(({sql}) AS VARCHAR) || ' rows' AS response, "
    f"FALSE AS pinned" for q, spec, sql in _LOGGED))(_query_log)


# D1-D3 ------------------------------------------------------------------------
def _ctx_sql(src, target, numeric):
    reg = (f"{'TRUE' if numeric else 'FALSE'} AND count(DISTINCT {target}) "
           f"+ max(CASE WHEN {target} IS NULL THEN 1 ELSE 0 END) > 10")
    return (f"SELECT 'General Business' AS industry, '{target}' AS target_variable, "
            f"CASE WHEN {reg} THEN 'RMSE, MAE, R² (Inferred Regression)' ELSE 'Accuracy, F1-Score, ROC-AUC (Inferred Classification)' END AS evaluation_metric, "
            f"CASE WHEN {reg} THEN 'Predicting continuous numeric values based on historical trends.' "
            f"ELSE 'Categorizing or classifying outcomes based on the provided features.' END AS business_summary, "
            f"'Show distribution of {target}.' AS suggested_query_1, "
            f"'How does {target} vary across different groups?' AS suggested_query_2 FROM {src}")


register("suggest_target", _ctx_sql("orders", "o_orderstatus", False))(
    lambda s, d: TG.domain_context(table(s, d, "orders")))
register("suggest_metric", _ctx_sql("part", "p_retailprice", True))(
    lambda s, d: TG.domain_context(table(s, d, "part")))

register("detect_task",
         " UNION ALL ".join(
             f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, CASE WHEN count(DISTINCT {c}) <= 20 "
             f"THEN 'classification' ELSE 'regression' END AS task FROM labels" for c in ("doc_id", "quality", "toxic")))(
    lambda s, d: TG.task_table(table(s, d, "labels")))
