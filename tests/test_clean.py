import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsense.operators import clean as CL

from table_rows import rows


def test_standardized_names_collisions_and_empty():
    assert CL.standardized_names([" First Name ", "A B", "a_b", "Prix (€)", "***"]) == \
        ["first_name", "a_b", "a_b_2", "prix_", "col_4"]


def test_dates(spark):
    ok = spark.createDataFrame([("2024-01-02",), (None,), ("2023-12-31",)], "s string")
    bad = spark.createDataFrame([("2024-01-02",), ("not a date",)], "s string")
    us = spark.createDataFrame([("01/02/2024",), ("12/31/2023",)], "s string")
    mixed = spark.createDataFrame([("01/02/2024",), ("13/01/2024",)], "s string")
    assert CL.detect_dates(ok) == {"s": "yyyy-MM-dd"}
    assert CL.detect_dates(bad) == {"s": None}
    assert CL.detect_dates(us) == {"s": "MM/dd/yyyy"}
    assert CL.detect_dates(mixed) == {"s": "dd/MM/yyyy"}
    out = CL.cast_dates(ok, CL.detect_dates(ok))
    assert out.first()["s"] == dt.datetime(2024, 1, 2)


def test_text_whitespace_and_null(spark):
    df = spark.createDataFrame([("\t Hello \n",), (None,)], "s string")
    assert rows(CL.clean_text(df)) == [("hello",), (None,)]
    assert rows(CL.clean_text(df, null_text="literal")) == [("hello",), ("nan",)]


def test_null_30_imputed_and_40_dropped(spark):
    v30 = [(float(i),) for i in range(7)] + [(None,)] * 3
    v40 = [(float(i),) for i in range(6)] + [(None,)] * 4
    p30 = CL.fit_impute(spark.createDataFrame(v30, "v double"))
    p40 = CL.fit_impute(spark.createDataFrame(v40, "v double"))
    assert p30.methods["v"] in ("mean", "median") and p40.methods["v"] == "drop"
    assert "30.0%" in p30.log["v"]


def test_skew_edges(spark):
    const = spark.createDataFrame([(2.0,)] * 4 + [(None,)], "v double")
    sym = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    tail = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "v double")
    assert CL.fit_impute(const).methods["v"] == "median"
    assert CL.fit_impute(sym).methods["v"] == "mean"
    pt = CL.fit_impute(tail)
    assert pt.methods["v"] == "median" and pt.fill["v"] == 2.5


def test_mode_impute(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    out, log = CL.impute(df)
    assert rows(out) == [("a",), ("a",), ("a",), ("b",), ("b",)]


def test_winsorize_iqr_known(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    plan = CL.fit_winsorize(df)
    assert plan.bounds["v"] == (-1.0, 7.0)
    assert rows(plan.transform(df)) == [(1.0,), (2.0,), (3.0,), (4.0,), (7.0,)]


def test_range_rule(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (2.0,), (None,)], "unit_price double")
    out = CL.winsorize(df)
    vals = [r[0] for r in out.collect()]
    assert min(v for v in vals if v is not None) >= 0 and None in vals
    assert CL.range_rule_applies("percentage") and not CL.range_rule_applies("percentage", "token")


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_fill_order_any_partitioning(spark, parts):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "k int, v double").repartition(parts)
    out = CL.fill_forward_backward(df, ["v"], "k")
    assert rows(out) == [(1, 5.0), (2, 5.0), (3, 5.0)]


def test_partitioned_fill_equals_window(spark):
    data = [(i, None if (i * 7) % 5 < 2 else float(i), None if i % 11 < 3 else dt.datetime(2024, 1, 1 + i % 28))
            for i in range(500)]
    # a hot order key: a third of the rows share key 250
    data = [(250 if i % 3 == 0 else k, v, t) for i, (k, v, t) in enumerate(data)]
    df = spark.createDataFrame(data, "k int, v double, t timestamp").repartition(7)
    a = CL.fill_forward_backward(df, ["v", "t"], "k", method="window")
    for n in (1, 5):
        p = CL.fill_forward_backward(df.repartition(n), ["v", "t"], "k")
        assert a.exceptAll(p).count() == 0 and p.exceptAll(a).count() == 0


def test_clean_properties(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn(
        "value", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")))
    res = CL.clean(df, order_by="event_id")
    out = res.df
    assert out.count() <= df.count()
    assert out.where(F.col("value").isNull()).count() == 0
    for c, (lo, hi) in res.winsor.bounds.items():
        assert out.where((F.col(c) < lo) | (F.col(c) > hi)).count() == 0


def test_partitioned_fill_text_order_key(spark):
    # text keys sharing long prefixes, a hot key, nulls in the key and the values
    keys = [f"key-{i % 37:03d}-{i:05d}" if i % 4 else "key-hot" for i in range(800)] + [None]
    data = [(k, None if i % 3 else float(i)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    a = CL.fill_forward_backward(df, ["v"], "k", method="window")
    p = CL.fill_forward_backward(df, ["v"], "k")
    assert a.exceptAll(p).count() == 0 and p.exceptAll(a).count() == 0


def test_dedup_and_distinct_rows(spark):
    from tabsense.operators import profile as P
    data = [(i % 50, None if i % 7 == 0 else float(i % 3), "x" if i % 2 else None) for i in range(400)]
    data += [(1, -0.0, "z"), (1, 0.0, "z"), (2, float("nan"), None), (2, None, None)]
    df = spark.createDataFrame(data, "a int, b double, s string").repartition(4)
    dedup, removed = CL.remove_duplicates(df)
    want = CL.normalize_missing(df).dropDuplicates()
    assert dedup.exceptAll(want).count() == 0 and want.exceptAll(dedup).count() == 0
    assert removed == df.count() - want.count()
    d = P.distinct_row_count(df).first()
    assert d["n_rows"] == df.count() and d["n_distinct"] == want.count()


def test_datetime_gaps_stay_without_order_key(spark, tmp_path):
    import datetime as dt
    data = [(i, None if i % 5 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i % 7))
            for i in range(300)]
    src = spark.createDataFrame(data, "i int, ts timestamp, StockExchange double")
    src.coalesce(1).write.parquet(str(tmp_path / "p"))
    for df in (spark.read.parquet(str(tmp_path / "p")), src.repartition(7)):
        got = CL.clean(df)
        assert got.impute.methods["ts"] == "none" and "ts" in got.log
        assert got.df.where("ts is null").count() == 60
    filled = [rows(CL.clean(src.repartition(n), order_by="i").df) for n in (1, 7)]
    assert filled[0] == filled[1] and not any(r[1] is None for r in filled[0])


def test_nan_is_missing(spark):
    from tabsense.operators import features as FT
    from tabsense.operators import profile as P
    nan = float("nan")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, nan, 30.0)], "v double")
    assert P.profile_schema(df).first()["null_count"] == 1
    mean, sd = next(iter(vars(FT.fit_zscore(df, ["v"])).values()))["v"]
    assert mean == 8.0 and sd == pytest.approx(11.045361)
    done, log = CL.impute(df)
    assert "v" in log and done.where("isnan(v) or v is null").count() == 0
    assert CL.fit_winsorize(df).bounds["v"] == (-1.0, 7.0)


def test_partitioned_fill_two_order_keys_with_hot_first_key(spark):
    # the first key is hot (half the rows share k1 = 5); order within it is by k2
    data = [(5 if i % 2 else i, (i * 37) % 1000, None if i % 3 else float(i)) for i in range(1200)]
    df = spark.createDataFrame(data, "k1 int, k2 int, v double").repartition(6)
    a = CL.fill_forward_backward(df, ["v"], ["k1", "k2"], method="window")
    p = CL.fill_forward_backward(df, ["v"], ["k1", "k2"])
    assert a.exceptAll(p).count() == 0 and p.exceptAll(a).count() == 0
