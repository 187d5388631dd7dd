import pytest
from pyspark.sql import functions as F

from tabsense.operators import features as FT

from table_rows import rows


def test_one_hot_drops_first_and_nulls_match_nothing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "s string")
    out = FT.one_hot(df, ["s"])
    assert out.columns == ["s_b", "s_c"]
    assert rows(out) == [(False, False), (False, False), (False, True), (True, False)]


def test_transform_boundary_10_11(spark):
    ten = spark.createDataFrame([(f"v{i:02d}", float(i)) for i in range(10)], "s string, x double")
    eleven = spark.createDataFrame([(f"v{i:02d}", float(i)) for i in range(11)], "s string, x double")
    assert len([c for c in FT.transform(ten).columns if c.startswith("s_")]) == 9
    out = FT.transform(eleven)
    assert "s" in out.columns and sorted(r["s"] for r in out.collect()) == list(range(11))


def test_label_codes_distributed_equals_broadcast(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    small = FT.label_encode(df, ["p_type"], sizes={"p_type": 10})
    big = FT.label_encode(df, ["p_type"], sizes={"p_type": 10 ** 9})
    assert rows(small) == rows(big)


def test_zscore_constant_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "a double, b double")
    out = FT.zscore(df)
    assert rows(out) == [(0.0, -1.0), (0.0, 1.0)]


def test_datetime_parts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 10:00:00' AS t, 1 AS x")
    out = FT.datetime_parts(df)
    assert out.columns == ["x", "t_year", "t_month", "t_day"] and tuple(out.first()) == (1, 2024, 3, 5)


def test_zscore_mean0_std1(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = FT.zscore(df, ["l_quantity"])
    s = out.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s")).first()
    assert abs(s["m"]) < 1e-9 and s["s"] == pytest.approx(1.0)
