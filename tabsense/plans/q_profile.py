"""Registered queries: profiling, health, previews."""
from __future__ import annotations

from ..operators import profile as P
from . import oracle as O
from .catalog import r6, register, with_
from .variants import table

# P1 ---------------------------------------------------------------------------
register("schema_profile", with_("customer_nulls") + O.profile_sql("customer_nulls", "customer_nulls"))(
    lambda s, d: r6(P.profile_schema(table(s, d, "customer_nulls"))))


def _health_sql(src):
    return with_(src) + O.health_sql(src, src).lstrip()


def _health_query(src):
    def run(s, d):
        h = P.health_components(table(s, d, src))
        return r6(h)
    return run


# Health on three inputs that trigger each component
register("null_cell_pct", _health_sql("customer_nulls"))(_health_query("customer_nulls"))
register("duplicate_row_pct", _health_sql("events_dups"))(_health_query("events_dups"))
register("dominant_columns", _health_sql("orders_dominant"))(_health_query("orders_dominant"))
register("health_score", _health_sql("lineitem"))(_health_query("lineitem"))

from ..operators import select as S  # noqa: E402
from ..sources.tables import preview  # noqa: E402
from .oracle import q, union_all  # noqa: E402
from .catalog import r6sql  # noqa: E402

# S5 ---------------------------------------------------------------------------
register("shape", "SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_cols FROM customer")(
    lambda s, d: P.shape(table(s, d, "customer")))

# S4 ---------------------------------------------------------------------------
register("preview", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey, o_custkey, "
         "o_orderstatus, o_orderdate, o_orderpriority LIMIT 50")(
    lambda s, d: preview(table(s, d, "orders"), 50, ["o_totalprice"], descending=True))


# P7 ---------------------------------------------------------------------------
def _column_stats_sql(src):
    parts = []
    for c, t in O.cols(src):
        qc = q(c)
        if t == O.N:
            parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(min({qc}) AS DOUBLE) AS min, "
                         f"CAST(max({qc}) AS DOUBLE) AS max, round(avg({qc}), 2) AS mean, "
                         f"count(DISTINCT {qc}) AS unique_count FROM {src}")
        else:
            parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(NULL AS DOUBLE) AS min, "
                         f"CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
                         f"count(DISTINCT {qc}) AS unique_count FROM {src}")
    return with_(src) + union_all(parts)


register("column_stats", _column_stats_sql("customer_nulls"))(
    lambda s, d: r6(P.column_stats(table(s, d, "customer_nulls"))))


# P8 ---------------------------------------------------------------------------
def _numeric_sql(src, columns, digits=None):
    parts = []
    rnd = (lambda e: f"round({e}, {digits})") if digits else (lambda e: r6sql(e))
    for c in columns:
        qc = q(c)
        parts.append(
            f"SELECT '{c}' AS \"column\", count({qc}) AS count, {rnd(f'avg({qc})')} AS mean, "
            f"{rnd(f'quantile_cont({qc}, 0.5)')} AS median, {rnd(f'stddev_samp({qc})')} AS std, "
            f"{rnd(f'min({qc})')} AS min, {rnd(f'max({qc})')} AS max, "
            f"{rnd(f'CASE WHEN count({qc}) < 3 THEN NULL WHEN var_pop({qc}) = 0 THEN 0.0 ELSE skewness({qc}) END')} AS skewness, "
            f"count(*) - count({qc}) AS null_count, "
            + (f"count(DISTINCT {qc}) AS unique_values, " if digits else "")
            + f"{rnd(f'quantile_cont({qc}, 0.25)')} AS q25, {rnd(f'quantile_cont({qc}, 0.75)')} AS q75 "
            f"FROM {src}")
    return with_(src) + union_all(parts)


register("distribution_numeric", _numeric_sql("events_nulls", ["value"], 4))(
    lambda s, d: r6(P.distribution_stats(table(s, d, "events_nulls"), "value")))

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]
register("numeric_stats", _numeric_sql("lineitem", _LI_NUM))(
    lambda s, d: r6(P.numeric_stats(table(s, d, "lineitem"))))


# P9 ---------------------------------------------------------------------------
def _categorical_sql(src, columns):
    parts = []
    for c in columns:
        qc = q(c)
        top = (f"(SELECT {{x}} FROM {src} WHERE {qc} IS NOT NULL GROUP BY {qc} "
               f"ORDER BY count(*) DESC, {qc} LIMIT 1)")
        parts.append(
            f"SELECT '{c}' AS \"column\", count({qc}) AS count, count(DISTINCT {qc}) AS unique_values, "
            f"count(*) - count({qc}) AS null_count, {top.format(x=qc)} AS mode, "
            f"{top.format(x='count(*)')} AS mode_count FROM {src}")
    return with_(src) + union_all(parts)


register("distribution_categorical", _categorical_sql("customer_nulls", ["c_name", "c_mktsegment"]))(
    lambda s, d: P.categorical_stats(table(s, d, "customer_nulls")))


def _topk_sql(src, columns, k):
    parts = []
    for c in columns:
        qc = q(c)
        parts.append(
            f"SELECT \"column\", CAST(rank AS INTEGER) AS rank, value, cnt FROM ("
            f"SELECT '{c}' AS \"column\", CAST({qc} AS VARCHAR) AS value, count(*) AS cnt, "
            f"row_number() OVER (ORDER BY count(*) DESC, CAST({qc} AS VARCHAR)) AS rank "
            f"FROM {src} WHERE {qc} IS NOT NULL GROUP BY {qc}) WHERE rank <= {k}")
    return with_(src) + union_all(parts)


register("value_counts_topk", _topk_sql("part", ["p_brand", "p_type"], 15))(
    lambda s, d: P.top_values(table(s, d, "part"), 15, ["p_brand", "p_type"]))


# P11 --------------------------------------------------------------------------
def _describe_sql(src):
    parts = []
    f2 = lambda e: f"printf('%.2f', round(CAST({e} AS DOUBLE), 2))"
    for c, t in O.cols(src):
        qc = q(c)
        if t == O.N:
            parts.append(
                f"SELECT '{c}' AS \"column\", 'Distribution of ''{c}'': mean=' || {f2(f'avg({qc})')} || "
                f"', median=' || {f2(f'median({qc})')} || ', std=' || {f2(f'stddev_samp({qc})')} || "
                f"', range=[' || {f2(f'min({qc})')} || ', ' || {f2(f'max({qc})')} || '], n=' || "
                f"CAST(count({qc}) AS VARCHAR) || '.' AS description FROM {src}")
        else:
            top = (f"(SELECT {{x}} FROM {src} WHERE {qc} IS NOT NULL GROUP BY {qc} "
                   f"ORDER BY count(*) DESC, {qc} LIMIT 1)")
            parts.append(
                f"SELECT '{c}' AS \"column\", 'Distribution of ''{c}'': ' || CAST(count(DISTINCT {qc}) AS VARCHAR) || "
                f"' unique values, n=' || CAST(count({qc}) AS VARCHAR) || '. Most frequent: ''' || "
                f"{top.format(x=qc)} || ''' (' || printf('%.1f', round({top.format(x='count(*)')} * 100.0 / count(*), 1)) || '%).' "
                f"AS description FROM {src}")
    return with_(src) + union_all(parts)


register("describe_text", _describe_sql("customer_nulls"))(
    lambda s, d: P.describe_columns(table(s, d, "customer_nulls")))

# P12 --------------------------------------------------------------------------
register("class_balance",
         "SELECT CAST(toxic AS VARCHAR) AS toxic, count(*) AS cnt, "
         "round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share "
         "FROM labels WHERE toxic IS NOT NULL GROUP BY toxic")(
    lambda s, d: r6(P.class_balance(table(s, d, "labels"), "toxic")))


# P13 --------------------------------------------------------------------------
def _null_matrix_sql(src, key, buckets):
    others = [c for c, _ in O.cols(src) if c != key]
    b = (f"CAST(least(floor((CAST({key} AS DOUBLE) - lo) / ((hi - lo + 1.0) / {buckets})), "
         f"{buckets - 1}) AS INTEGER)")
    parts = [f"SELECT bucket, '{c}' AS \"column\", CAST(sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
             f"count(*) AS n_rows FROM b GROUP BY bucket" for c in others]
    return (with_(src) + f", m AS (SELECT CAST(min({key}) AS DOUBLE) AS lo, CAST(max({key}) AS DOUBLE) AS hi FROM {src}), "
            f"b AS (SELECT {src}.*, {b} AS bucket FROM {src}, m) " + union_all(parts))


register("null_matrix", _null_matrix_sql("events_nulls", "event_id", 20))(
    lambda s, d: P.null_matrix(table(s, d, "events_nulls"), "event_id", 20))

# P6 ---------------------------------------------------------------------------
register("health_label", with_("customer_nulls") + O.health_sql(
    "customer_nulls", "customer_nulls",
    outer="health_score, CASE WHEN health_score >= 80 THEN 'Excellent' "
          "WHEN health_score >= 50 THEN 'Needs Review' ELSE 'Critical' END AS health_label"))(
    lambda s, d: r6(P.health_score(table(s, d, "customer_nulls")).select("health_score", "health_label")))


# F1-F4 ------------------------------------------------------------------------
def _rules_sql(src, pick):
    return with_(src) + O.rules_sql(src, src, outer=f"SELECT {pick}")


def _rules_query(src, pick):
    return lambda s, d: S.rule_columns(table(s, d, src)).select(*pick.replace('"', "").split(", "))


register("filter_zero_variance", _rules_sql("orders_constant", '"column", zero_variance'))(
    _rules_query("orders_constant", '"column", zero_variance'))
register("filter_id_named", _rules_sql("events", '"column", id_named'))(
    _rules_query("events", '"column", id_named'))
register("filter_unique_text", _rules_sql("customer", '"column", unique_text'))(
    _rules_query("customer", '"column", unique_text'))
register("drop_log", _rules_sql("events_dups", 'position, "column", rule, reason') + " WHERE rule IS NOT NULL")(
    lambda s, d: S.drop_log(table(s, d, "events_dups")))

# P9 on long texts: exact top-k by hash (texts are not shuffled)
register("value_counts_topk_text", _topk_sql("documents", ["text"], 5))(
    lambda s, d: P.top_values(table(s, d, "documents"), 5, ["text"]))

# P1, P2-P5, F1-F4 on decimal keys beyond 2**53
register("decimal_schema_profile", with_("orders_decimal") + O.profile_sql("orders_decimal", "orders_decimal"))(
    lambda s, d: r6(P.profile_schema(table(s, d, "orders_decimal"))))
register("decimal_health", _health_sql("orders_decimal"))(_health_query("orders_decimal"))
register("decimal_filter", _rules_sql("orders_decimal", '"column", zero_variance, id_named, unique_text'))(
    _rules_query("orders_decimal", '"column", zero_variance, id_named, unique_text'))
