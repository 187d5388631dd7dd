import random

import pytest
from pyspark.sql import functions as F

from tabsense.functions.quantiles import exact_quantiles
from tabsense.operators import correlate as CR


def test_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, None), (4.0, 4.0)], "a double, b double")
    m = {(r["col1"], r["col2"]): r["r"] for r in CR.correlation_matrix(df).collect()}
    assert m[("a", "b")] == pytest.approx(0.9285714, abs=1e-7)
    assert m[("a", "a")] == 1.0


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0), (1.0, 7.0)], "a double, b double")
    m = {(r["col1"], r["col2"]): r["r"] for r in CR.correlation_matrix(df).collect()}
    assert m[("a", "b")] is None and m[("a", "a")] is None and m[("b", "b")] == 1.0


def test_fewer_than_two_numeric(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, s string")
    assert CR.correlation_matrix(df).count() == 0


def test_selection_equals_percentile(spark):
    rnd = random.Random(7)
    vals = [(rnd.choice([1.0, 2.0, 3.0]) if i % 3 == 0 else rnd.random() * 1000,) for i in range(5000)]
    vals += [(None,)] * 10
    df = spark.createDataFrame(vals, "v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    for bins in (2, 3, 4096):
        assert exact_quantiles(df, {"v": F.col("v")}, probs, bins=bins)["v"] == pytest.approx(want, abs=1e-12)


def test_selection_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    vals = [1e308, -1e308, 5e-324, 0.0, -0.0, inf, -inf, nan, None, 1.0, 1.0 + 2 ** -52]
    df = spark.createDataFrame([(v, nan) for v in vals], "v double, w double").repartition(3)
    real = sorted(v for v in vals if v is not None and v == v)
    probs = [k / 8 for k in range(9)]
    got = exact_quantiles(df, {"v": F.col("v"), "w": F.col("w")}, probs, bins=4)
    assert got["w"] == [None] * 9
    assert all(g == pytest.approx(w) for g, w in zip(got["v"], real, strict=True))


def test_grouped_quantiles_hot_group(spark):
    from tabsense.functions.quantiles import grouped_quantiles
    rnd = random.Random(11)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", float(rnd.randint(0, 400)) if i % 5 else None)
            for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in grouped_quantiles(df, ["g"], F.col("v"), probs).collect()}
    want = {r["g"]: [r[f"p{i}"] for i in range(len(probs))]
            for r in df.groupBy("g").agg(*[F.percentile("v", p).alias(f"p{i}") for i, p in enumerate(probs)]).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


def test_query_median_matches_percentile(spark):
    from tabsense.operators.query import run_query
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = {r["l_returnflag"]: (r["m"], r["n"]) for r in run_query(df, {
        "group_by": ["l_returnflag"], "aggregations": [["l_extendedprice", "median", "m"], ["*", "count", "n"]]}).collect()}
    want = {r["l_returnflag"]: (r["m"], r["n"]) for r in df.groupBy("l_returnflag").agg(
        F.percentile("l_extendedprice", 0.5).alias("m"), F.count("*").alias("n")).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1]


def test_wide_correlation_path_matches(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn(
        "l_tax", F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_tax"))).withColumn("k", F.lit(1.0))
    narrow = {(r["col1"], r["col2"]): r["r"] for r in CR.correlation_matrix(df).collect()}
    wide = {(r["col1"], r["col2"]): r["r"] for r in CR.correlation_matrix(df, wide_columns=2).collect()}
    assert set(narrow) == set(wide)
    for key, v in narrow.items():
        assert (v is None and wide[key] is None) or wide[key] == pytest.approx(v, abs=1e-9)


def test_quantiles_of_many_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    ex = {c: F.col(c) for c, t in df.dtypes if t in ("bigint", "int", "double")}
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ex, probs)
    for k, e in ex.items():
        want = df.agg(F.percentile(e, F.array(*[F.lit(p) for p in probs]))).first()[0]
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_two_hundred_columns_with_nulls(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 200)) + rng.normal(size=(150, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])
    want = pdf.corr()
    got = CR.correlation_matrix(spark.createDataFrame(pdf)).collect()
    assert len(got) == 200 * 200
    assert all(r["r"] == pytest.approx(want.loc[r["col1"], r["col2"]], abs=1e-9) for r in got)
