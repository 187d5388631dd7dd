import pytest

from tabsense.operators import charts as CH
from tabsense.operators import query as QY

from table_rows import rows


def test_histogram_max_in_last_bin_and_single_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in CH.histogram(df, "x", bins=2).collect()}
    assert h == {0: 1, 1: 2}
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [tuple(r) for r in CH.histogram(const, "x").select("bin", "count").collect()] == [(0, 2)]


def test_resolve_chart_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    one = spark.createDataFrame([("a",)], "k string")
    assert CH.resolve_chart(one, "bar").chart_type == "histogram"
    assert CH.resolve_chart(df, "line", x="k").y == "x"            # y defaults to the 2nd column
    assert CH.resolve_chart(one, "line").chart_type == "histogram"
    assert CH.resolve_chart(df, "nonsense").chart_type == "bar"
    assert CH.resolve_chart(df, "histogram", x="x").y is None        # y omitted means count


def test_area_running_total(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 1.0), (3, 4.0)], "x int, y double")
    out = CH.area(df, "x", "y")
    assert rows(out, "x", "cumulative") == [(1, 2.0), (2, 6.0), (3, 10.0)]


def test_query_spec_groupby_and_topk(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    out = QY.run_query(df, {"group_by": ["k"], "aggregations": [["v", "mean", "m"]],
                            "order_by": [["m", "desc"]], "limit": 1})
    assert [tuple(r) for r in out.collect()] == [("b", 5.0)]


def test_query_errors(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(Exception):
        QY.run_query(df, {"filter": "nope > 1"})
    assert QY.run_query(df, {"filter": "nope > 1"}, on_error="input") is df
    with pytest.raises(Exception):
        QY.run_sql(df, "DROP TABLE x")
    assert QY.run_sql(df, "SELECT a + 1 AS b FROM {df}").first()["b"] == 2


def test_spec_json_roundtrip():
    spec = QY.QuerySpec(filter="a > 1", limit=3)
    assert QY.QuerySpec.from_json(spec.to_json()) == spec


def test_area_running_total_text_x(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(f"stage-{i % 23:02d}", c, float(i)) for i, c in
                                zip(range(400), ["a", "b"] * 200)], "x string, c string, y double")
    got = CH.area(df, "x", "y", "c")
    w = Window.partitionBy("c").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    want = CH.bar(df, "x", "y", "c").withColumn("cumulative", F.sum("sum_y").over(w))
    assert rows(got, "x", "c", "cumulative") == rows(want, "x", "c", "cumulative")


@pytest.mark.parametrize("kind", list(CH.CHART_TYPES) + ["unknown_type"])
def test_every_chart_type_runs(spark, kind):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus", "l_discount")
    spec = CH.resolve_chart(df, kind, x="l_returnflag", y="l_quantity", color="l_linestatus",
                            z="l_discount", path=["l_returnflag", "l_linestatus"])
    out = CH.chart_data(df, spec)
    assert out.count() > 0


def test_resolve_chart_of_names_that_are_none(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, "c")], "k string, x double, y double, s string")
    words = spark.createDataFrame([("a", "b")], "k string, s string")
    assert CH.resolve_chart(df, "line", "x", "no").y == ["y"]          # wide form
    assert CH.resolve_chart(df, "area", "k", "no").y == ["x", "y"]
    assert CH.resolve_chart(words, "area", "k", "no").chart_type == "histogram"
    assert CH.resolve_chart(df, "bar", "no", "no") == CH.ChartSpec("histogram", "k", None)
    assert CH.resolve_chart(df, "Scatter", "y", "no", "no").y is None
    assert CH.resolve_chart(df, None) == CH.ChartSpec("bar", "k", "x")
    assert CH.resolve_chart(words, "x") == CH.ChartSpec("histogram", "k")
    assert CH.resolve_chart(df, "treemap", "k", "x", path=["s", "no"]).path == ["s"]


def test_pivot_counts_its_columns_first(spark):
    df = spark.range(60).selectExpr("id % 2 AS g", "id % 12 AS p", "id AS v")
    spec = {"group_by": ["g"], "pivot": {"column": "p", "max_columns": 12},
            "aggregations": [["v", "sum", "s"]]}
    assert len(QY.run_query(df, spec).columns) == 13
    spec["pivot"]["max_columns"] = 11
    with pytest.raises(QY.QueryError, match="12 values, more than 11"):
        QY.run_query(df, spec)
    spec["pivot"]["values"] = [1, 5]
    assert len(QY.run_query(df, spec).columns) == 3
