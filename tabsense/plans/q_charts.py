"""Registered queries: chart-ready tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as CH
from .catalog import r6, r6sql, register
from .variants import table


def _run(src, fn):
    return lambda s, d: r6(fn(table(s, d, src)))


_HIST = """WITH m AS (SELECT CAST(min(l_extendedprice) AS DOUBLE) AS lo, CAST(max(l_extendedprice) AS DOUBLE) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((CAST(l_extendedprice AS DOUBLE) - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi
      FROM lineitem, m WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS bin_start,
       round(CASE WHEN bin = 19 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 20) END, 6) AS bin_end, count(*) AS count
FROM b GROUP BY bin, lo, hi"""
register("chart_histogram", _HIST)(_run("lineitem", lambda df: CH.histogram(df, "l_extendedprice")))

register("chart_histogram_text",
         "SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderpriority, o_orderstatus")(
    _run("orders", lambda df: CH.histogram(df, "o_orderpriority", color="o_orderstatus")))

_BOX = """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                   quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag)
SELECT l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END), 6) AS lower_whisker,
       round(max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 6) AS upper_whisker,
       count(CASE WHEN l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers,
       count(*) AS n
FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag, q1, median, q3"""
register("chart_box", _BOX)(_run("lineitem", lambda df: CH.box(df, "l_extendedprice", "l_returnflag")))

register("chart_bar",
         "SELECT o_orderpriority, o_orderstatus, " + r6sql("sum(o_totalprice)") + " AS sum_o_totalprice "
         "FROM orders GROUP BY o_orderpriority, o_orderstatus")(
    _run("orders", lambda df: CH.bar(df, "o_orderpriority", "o_totalprice", "o_orderstatus")))

register("chart_line",
         "SELECT l_linenumber, l_returnflag, " + r6sql("sum(l_quantity)") + " AS sum_l_quantity "
         "FROM lineitem GROUP BY l_linenumber, l_returnflag")(
    _run("lineitem", lambda df: CH.line(df, "l_linenumber", "l_quantity", "l_returnflag")))

register("chart_area",
         "SELECT l_linenumber, l_returnflag, " + r6sql("s") + " AS sum_l_quantity, "
         + r6sql("sum(s) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
         + " AS cumulative FROM (SELECT l_linenumber, l_returnflag, sum(l_quantity) AS s FROM lineitem "
           "GROUP BY l_linenumber, l_returnflag)")(
    _run("lineitem", lambda df: CH.area(df, "l_linenumber", "l_quantity", "l_returnflag")))

_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("chart_wide_form",
         " UNION ALL ".join(f"SELECT l_linenumber, '{c}' AS variable, " + r6sql(f"sum(CAST({c} AS DOUBLE))")
                            + " AS value FROM lineitem GROUP BY l_linenumber" for c in _WIDE))(
    _run("lineitem", lambda df: CH.chart_data(df, CH.ChartSpec("line", "l_linenumber", _WIDE))))

register("chart_scatter", "SELECT o_totalprice, o_custkey, o_orderstatus FROM orders")(
    _run("orders", lambda df: CH.scatter(df, "o_totalprice", "o_custkey", "o_orderstatus")))

_VIOLIN = """WITH m AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi FROM lineitem),
q AS (SELECT l_linestatus, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
             quantile_cont(l_quantity, 0.75) AS q3, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_linestatus),
w AS (SELECT l_linestatus, min(CASE WHEN l_quantity >= q1 - 1.5 * (q3 - q1) THEN l_quantity END) AS lower_whisker,
             max(CASE WHEN l_quantity <= q3 + 1.5 * (q3 - q1) THEN l_quantity END) AS upper_whisker
      FROM lineitem JOIN q USING (l_linestatus) GROUP BY l_linestatus),
c AS (SELECT l_linestatus, CAST(least(floor((CAST(l_quantity AS DOUBLE) - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin,
             count(*) AS cnt FROM lineitem, m WHERE l_quantity IS NOT NULL GROUP BY ALL)
SELECT c.l_linestatus, bin, round(lo + bin * ((hi - lo) / 20), 6) AS bin_start, cnt,
       round(cnt / (n * ((hi - lo) / 20)), 6) AS density, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(lower_whisker, 6) AS lower_whisker, round(upper_whisker, 6) AS upper_whisker
FROM c JOIN q USING (l_linestatus) JOIN w USING (l_linestatus), m"""
register("chart_violin", _VIOLIN)(_run("lineitem", lambda df: CH.violin(df, "l_quantity", "l_linestatus")))

register("chart_pie",
         "SELECT o_orderpriority, " + r6sql("sum(o_totalprice)") + " AS sum_o_totalprice, "
         + r6sql("sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)") + " AS share FROM orders GROUP BY o_orderpriority")(
    _run("orders", lambda df: CH.pie(df, "o_orderpriority", "o_totalprice")))

register("chart_pie_counts",
         "SELECT o_orderstatus, count(*) AS count, " + r6sql("count(*) / (SELECT count(*) FROM orders)")
         + " AS share FROM orders GROUP BY o_orderstatus")(
    _run("orders", lambda df: CH.pie(df, "o_orderstatus")))

register("chart_treemap",
         "SELECT p_brand, " + r6sql("sum(p_retailprice)") + " AS sum_p_retailprice FROM part GROUP BY p_brand")(
    _run("part", lambda df: CH.treemap(df, ["p_brand"], "p_retailprice")))

register("chart_funnel",
         "SELECT o_orderstatus, count, CAST(row_number() OVER w AS INTEGER) AS stage, "
         + r6sql("count / first_value(count) OVER w") + " AS pct_of_first, "
         + r6sql("count / lag(count) OVER w") + " AS pct_of_previous "
         "FROM (SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus) "
         "WINDOW w AS (ORDER BY count DESC, o_orderstatus)")(
    _run("orders", lambda df: CH.funnel(df, "o_orderstatus")))

register("chart_sunburst",
         "SELECT l_returnflag, l_linestatus, " + r6sql("sum(l_quantity)") + " AS sum_l_quantity, "
         "CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS level_id FROM lineitem "
         "GROUP BY ROLLUP (l_returnflag, l_linestatus)")(
    _run("lineitem", lambda df: CH.sunburst(df, ["l_returnflag", "l_linestatus"], "l_quantity")
         .withColumn("level_id", F.col("level_id").cast("bigint"))))

register("chart_heatmap",
         "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    _run("lineitem", lambda df: CH.heatmap(df, "l_returnflag", "l_linestatus")))

register("chart_xyz", "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")(
    _run("lineitem", lambda df: CH.xyz(df, "l_quantity", "l_extendedprice", "l_discount")))

register("chart_surface",
         "SELECT l_linenumber, l_quantity, " + r6sql("avg(l_tax)") + " AS avg_l_tax FROM lineitem GROUP BY l_linenumber, l_quantity")(
    _run("lineitem", lambda df: CH.surface(df, "l_linenumber", "l_quantity", "l_tax")))

register("chart_bar_3d",
         "SELECT l_returnflag, l_linestatus, " + r6sql("sum(l_extendedprice)") + " AS sum_l_extendedprice "
         "FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    _run("lineitem", lambda df: CH.bar_3d(df, "l_returnflag", "l_linestatus", "l_extendedprice")))
