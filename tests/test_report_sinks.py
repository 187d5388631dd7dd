import datetime as dt

from pyspark.sql import functions as F

from tabsense.functions.text import ascii_strip, latin1_cell
from tabsense.operators import report as RP
from tabsense.operators.query import QueryLog, QuerySpec

from table_rows import rows


def test_text_sanitisers(spark):
    df = spark.createDataFrame([("café ☕ naïve — ok",)], "s string")
    r = df.select(ascii_strip(F.col("s")).alias("a"), latin1_cell(F.col("s"), 12).alias("b")).first()
    assert r["a"] == "caf  nave  ok"
    assert r["b"] == "café ?"                      # non-Latin-1 -> "?", cut to int(12 / 2) = 6 chars


def test_report_leaderboard_and_importance(spark):
    board = spark.createDataFrame([(1, "A", 0.5), (2, "B", None)], "rank int, model string, f1 double")
    assert [tuple(r) for r in RP.report_leaderboard(board, "classification").collect()] == \
        [("A", "0.5000"), ("B", "0.0000")]
    imp = spark.createDataFrame([(1, "x" * 60, 0.7)], "rank int, feature string, importance double")
    assert len(RP.report_importance(imp).first()["feature"]) == 40
    assert RP.default_title("sales.csv") == "sales.csv — Analytical Report"


def test_audit_appendix_strips_non_ascii(spark):
    audit = spark.createDataFrame([(1, "Step ✅", "done → ok", "Success")],
                                  "step_no int, step string, detail string, status string")
    r = RP.audit_appendix(audit).first()
    assert r["step"] == "Step " and r["detail"] == "done  ok" and r["step_no"] == 1


def test_query_log_sink(spark, tmp_path):
    log = QueryLog()
    log.log("q1", QuerySpec(filter="a > 1"), "3 rows", pinned=True, at=dt.datetime(2024, 1, 1))
    log.write(spark, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).first()
    assert back["question"] == "q1" and back["pinned"] is True and "a > 1" in back["spec"]


def test_pipeline_result_write(spark, tmp_path):
    from tabsense import run_pipeline
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    res = run_pipeline(df, source="orders")
    res.write(str(tmp_path / "out"))
    for part in ("clean", "transformed", "decisions", "audit", "profile"):
        assert spark.read.parquet(str(tmp_path / "out" / part)).count() >= 0
    assert spark.read.parquet(str(tmp_path / "out" / "clean")).count() == res.clean.count()
    res.release()


def test_sweep_audit_rows_appended_once(spark):
    from tabsense import run_pipeline
    r = run_pipeline(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), source="orders")
    res = r.add_sweep()
    r.add_sweep()
    steps = [x["step"] for x in r.audit().orderBy("step_no").collect()]
    assert steps[15:] == ["Train/Test Split", "Algorithm Sweep", "Best Model Selection",
                          "Feature Importance Extraction"]
    assert res.task == "classification" and 0.0 <= res.best_metric_value <= 1.0
    r.release()
