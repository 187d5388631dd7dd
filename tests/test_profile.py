import math

import pytest
from pyspark.sql import functions as F

from tabsense.operators import profile as P

from table_rows import rows


def test_zero_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    prof = {r["column"]: r for r in P.profile_schema(df).collect()}
    assert prof["a"]["null_percentage"] == 0.0 and prof["a"]["cardinality"] == 0
    assert P.health_components(df).first()["health_score"] == 0.0


def test_profile_counts_null_as_value(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (None, None)], "a int, b string")
    prof = {r["column"]: r for r in P.profile_schema(df).collect()}
    assert prof["a"]["cardinality"] == 2 and prof["a"]["null_count"] == 1
    assert prof["b"]["cardinality"] == 2
    assert math.isclose(prof["b"]["null_percentage"], 200 / 3)
    assert prof["a"]["dtype"] == "numeric" and prof["b"]["dtype"] == "categorical"


def test_dominance_threshold_is_strict(spark):
    # 95 of 100 non-null -> not dominant; 96 -> dominant; nulls not in the denominator
    a = spark.createDataFrame([("a",)] * 95 + [("b",)] * 5 + [(None,)] * 50, "s string")
    b = spark.createDataFrame([("a",)] * 96 + [("b",)] * 4, "s string")
    assert P.health_components(a).first()["dominant_columns"] == 0
    assert P.health_components(b).first()["dominant_columns"] == 1


def test_health_formula(spark):
    # 4 rows x 2 cols, 1 null cell (12.5 %), 1 duplicate row (25 %), 0 dominant
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "x int, s string")
    h = P.health_components(df).first()
    assert h["null_cell_pct"] == 12.5 and h["duplicate_row_pct"] == 25.0
    assert h["health_score"] == round(100 - (12.5 * 0.5 + 25 * 0.3), 2)


def test_nan_and_null_are_one_missing_value(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (None,)], "d double")
    h = P.health_components(df).first()
    assert h["null_cell_pct"] == 100.0
    assert h["duplicate_row_pct"] == pytest.approx(200 / 3)


@pytest.mark.parametrize("score,label", [(100, "Excellent"), (80, "Excellent"), (79.99, "Needs Review"),
                                         (50, "Needs Review"), (49.99, "Critical"), (0, "Critical")])
def test_health_label(spark, score, label):
    df = spark.createDataFrame([(float(score),)], "s double")
    assert df.select(P.health_label(F.col("s"))).first()[0] == label


def test_iqr_known_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    s = P.distribution_stats(df, "v").first()
    assert s["std"] == 43.6177 and s["skewness"] == 2.2324
    assert s["q25"] == 2.0 and s["q75"] == 4.0 and s["median"] == 3.0


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert P.modes(df).first()["mode"] == "a"


def test_numeric_mode_orders_numerically(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,)], "n int")
    assert P.modes(df).first()["mode"] == "9"


def test_constant_skewness_is_zero_and_short_is_null(spark):
    const = spark.createDataFrame([(2.0,)] * 4, "v double")
    short = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert P.distribution_stats(const, "v").first()["skewness"] == 0.0
    assert P.distribution_stats(short, "v").first()["skewness"] is None


def test_top_values_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "s string")
    assert rows(P.top_values(df, 2), "rank", "value") == [(1, "c"), (2, "a")]


def test_count_distinct_profile_matches(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = rows(P.profile_schema(df))
    b = rows(P.profile_schema_count_distinct(df))
    assert a == b


def test_null_matrix_sums(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i) for i in range(30)], "id int, v int")
    m = P.null_matrix(df, "id", 5)
    assert sum(r["null_count"] for r in m.collect()) == 10
    assert sum(r["n_rows"] for r in m.collect()) == 30


def test_wide_and_long_forms_agree(spark):
    from tabsense.functions.moments import column_moments
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn(
        "value", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("value")))
    a, b = column_moments(df), column_moments(df, wide=0)
    for c in a:
        for k, v in a[c].items():
            if isinstance(v, str) or v is None:
                assert b[c][k] == v
            else:
                assert b[c][k] == pytest.approx(v, rel=1e-9, abs=1e-12)
    m1 = rows(P.null_matrix(df, "event_id", 7))
    m2 = rows(P.null_matrix(df, "event_id", 7, wide=0))
    assert m1 == m2


@pytest.mark.parametrize("table_name,column", [("documents", "text"), ("customer", "c_name"),
                                               ("conversations", "text"), ("pages", "html")])
def test_text_topk_by_hash_matches_values(spark, table_name, column):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table_name}.parquet")
    for k in (1, 3, 15):
        a = rows(P.top_values(df, k, [column], text="hash"), "rank", "value", "cnt")
        b = rows(P.top_values(df, k, [column], text="value"), "rank", "value", "cnt")
        assert a == b
    assert rows(P.modes(df, [column], text="hash")) == rows(P.modes(df, [column], text="value"))


def test_text_topk_ties_above_one(spark):
    import tabsense.functions.texttop as TT
    data = [("x" * 70 + str(i % 9),) for i in range(90)] + [("y" * 70,)] * 20 + [(None,)] * 3
    df = spark.createDataFrame(data, "s string")
    for k in (1, 2, 5, 12):
        assert rows(P.top_values(df, k, ["s"], text="hash")) == rows(P.top_values(df, k, ["s"], text="value"))
    assert TT.top_text(df, "s", 3) is not None


def test_long_decimal_keys_are_told_apart(spark):
    from decimal import Decimal

    from tabsense.operators import clean as CL
    from tabsense.operators import select as SL
    df = spark.createDataFrame([(Decimal(2 ** 80 + k), k % 2) for k in range(5)], "key_id decimal(38,0), v int")
    p = {r["column"]: r["cardinality"] for r in P.profile_schema(df).collect()}
    assert p == {"key_id": 5, "v": 2}
    h = P.health_components(df).first()
    assert (h["duplicate_row_pct"], h["dominant_columns"], h["health_score"]) == (0.0, 0, 100.0)
    assert SL.filter_features(df)[1] == {"key_id": "Detected as a primary key/ID by name ('key_id')."}
    assert CL.remove_duplicates(df.drop("v"))[1] == 0
    from tabsense.plans.automatic import run_pipeline
    res = run_pipeline(df.withColumnRenamed("key_id", "key"), source="t")
    assert res.filtered.columns == ["key", "v"]
