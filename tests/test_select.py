from tabsense.operators import select as S


def _drops(df):
    return S.fit_feature_filter(df).drops


def test_id_half_kept_and_above_dropped(spark):
    half = spark.createDataFrame([(i % 5,) for i in range(10)], "user_id int")          # 5 of 10
    more = spark.createDataFrame([(i % 6,) for i in range(10)], "user_id int")          # 6 of 10
    assert "user_id" not in _drops(half)
    assert "user_id" in _drops(more)


def test_rules_order_and_reasons(spark):
    df = spark.createDataFrame([(i, "x", f"n{i}", None) for i in range(4)],
                               "id int, const string, name string, empty string")
    d = _drops(df)
    assert d["const"].startswith("Zero-variance") and d["empty"].startswith("Zero-variance")
    assert d["id"] == "Detected as a primary key/ID by name ('id')."
    assert d["name"].startswith("100% unique string")


def test_numeric_unique_not_text_rule(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "amount int, flag int")
    assert _drops(df) == {}


def test_empty_frame_unchanged(spark):
    df = spark.createDataFrame([], "id int")
    assert _drops(df) == {}
