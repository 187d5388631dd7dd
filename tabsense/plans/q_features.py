"""Registered queries: feature transformation (T1-T6) and correlation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as CR
from ..operators import features as FT
from . import oracle as O
from .catalog import r6, r6sql, register, with_
from .variants import table

_DP = ("CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, "
       "CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
       "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day")

register("datetime_parts",
         f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, {_DP} FROM orders")(
    lambda s, d: FT.datetime_parts(table(s, d, "orders")))

# The category sets of the two orders columns (first one dropped).
_STATUS = ["F", "O", "P"]
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_OH = ", ".join([f"coalesce(o_orderstatus = '{v}', FALSE) AS \"o_orderstatus_{v}\"" for v in _STATUS[1:]]
                + [f"coalesce(o_orderpriority = '{v}', FALSE) AS \"o_orderpriority_{v}\"" for v in _PRIO[1:]])

register("one_hot", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, {_OH} FROM orders")(
    lambda s, d: FT.one_hot(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]))

register("label_encode",
         "SELECT p_partkey, p_name, p_brand, CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'nan')) - 1 AS INTEGER) "
         "AS p_type, p_size, p_retailprice FROM part")(
    lambda s, d: FT.label_encode(table(s, d, "part"), ["p_type"]))

register("bool_to_int",
         "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_final FROM orders")(
    lambda s, d: FT.bool_to_int(table(s, d, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("is_final"))))

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


def _z(c):
    return (f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE "
            f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END")


register("zscore",
         "SELECT " + ", ".join(r6sql(_z(c)) + f" AS {c}" for c in _LI_NUM)
         + ", l_returnflag, l_linestatus, l_shipdate FROM lineitem")(
    lambda s, d: r6(FT.zscore(table(s, d, "lineitem"))))

register("transform_full",
         "SELECT " + ", ".join(r6sql(_z(c)) + f" AS {c}" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
         + f", {_DP}, {_OH} FROM orders")(
    lambda s, d: r6(FT.transform(table(s, d, "orders"))))


# C1/C2 ------------------------------------------------------------------------
def _corr_sql(src, columns):
    parts = []
    for a in columns:
        for b in columns:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            sd = (f"(stddev_pop({a}) FILTER (WHERE {both}) * stddev_pop({b}) FILTER (WHERE {both}))")
            r = (f"CASE WHEN {sd} > 0 THEN "
                 + ("1.0" if a == b else f"covar_pop({a}, {b}) FILTER (WHERE {both}) / {sd}")
                 + " END")
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {r6sql(r)} AS r FROM {src}")
    return with_(src) + O.union_all(parts)


register("correlation_matrix", _corr_sql("customer_nulls", ["c_custkey", "c_nationkey", "c_acctbal"]))(
    lambda s, d: r6(CR.correlation_matrix(table(s, d, "customer_nulls"))))
register("correlation_lineitem", _corr_sql("lineitem", _LI_NUM))(
    lambda s, d: r6(CR.correlation_matrix(table(s, d, "lineitem"))))


def _strong_sql(src, columns):
    pos = {c: i for i, c in enumerate(columns)}
    m = _corr_sql(src, columns)
    case = "CASE " + " ".join(f"WHEN col1 = '{c}' THEN {i}" for c, i in pos.items()) + " END"
    case2 = case.replace("col1", "col2")
    return (f"SELECT col1, col2, round(r, 3) AS r FROM ({m}) m "
            f"WHERE {case} < {case2} AND abs(round(r, 3)) > 0.3 "
            f"ORDER BY abs(round(r, 3)) DESC, {case}, {case2} LIMIT 10")


register("strong_correlations", _strong_sql("part", ["p_partkey", "p_size", "p_retailprice"]))(
    lambda s, d: CR.strong_pairs(table(s, d, "part")))

# T3 at a vocabulary size above the broadcast bound: distributed ranking
# (range partition, per-partition offsets, checkpoint) and a shuffle join
register("label_encode_distributed", (
    "SELECT p_partkey, p_name, p_brand, CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'nan')) - 1 AS INTEGER) "
    "AS p_type, p_size, p_retailprice FROM part"))(
    lambda s, d: FT.label_encode(table(s, d, "part"), ["p_type"], sizes={"p_type": FT.VOCAB_BROADCAST_MAX + 1}))
