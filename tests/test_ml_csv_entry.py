import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabsense.operators import ml as ML
from tabsense.sources import csv as CSV


def test_planted_signal(spark):
    rnd = random.Random(1)
    data = []
    for _ in range(1500):
        x1, x2, x3 = rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)
        data.append((x1, x2, x3, "yes" if x1 + 2 * x2 > 0 else "no"))
    df = spark.createDataFrame(data, "x1 double, x2 double, x3 double, label string")
    res = ML.sweep(df, "label")
    assert res.task == "classification" and res.best_metric_value > 0.9
    imp = [r["feature"] for r in res.feature_importance.orderBy("rank").collect()]
    assert imp.index("x2") < imp.index("x1") and imp[-1] == "x3"


def test_auc_matches_pairwise_count(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), float(rnd.randint(0, 5))) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, score double")
    got = ML.roc_auc(df, "label", "score").first()["roc_auc"]
    pos = [s for l, s in data if l == 1]
    neg = [s for l, s in data if l == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert got == pytest.approx(brute)


def test_weighted_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, prediction int")
    m = ML.classification_metrics(df).first()
    # per-class F1: 0 -> 2/3, 1 -> 2*2/(2+4) = 2/3, 2 -> 0; weights 2, 2, 1
    assert m["accuracy"] == pytest.approx(0.6) and m["f1"] == pytest.approx((2 * 2 / 3 + 2 * 2 / 3) / 5)


def test_split_is_stable_under_repartition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = {r["side"]: r["n"] for r in ML.split_sizes(df).collect()}
    b = {r["side"]: r["n"] for r in ML.split_sizes(df.repartition(13)).collect()}
    assert a == b


def test_split_of_copies_and_after_scaling(spark):
    from tabsense.operators import features as FT
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").drop("doc_id")
    n = {r["side"]: r["n"] for r in ML.split_sizes(labels).collect()}
    assert 0.78 < n["train"] / sum(n.values()) < 0.82
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    sides = []
    for parts in (1, 7, 16):
        ready = FT.transform(ML.with_side(items.repartition(parts)))
        train, test = ML.split(ready)
        sides.append((train.count(), test.count()))
    assert len(set(sides)) == 1 and sum(sides[0]) == items.count()


def test_sweep_with_missing_features_and_empty_sides(spark):
    rnd = random.Random(4)
    data = [(rnd.gauss(0, 1), None if i % 6 == 0 else rnd.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame([(a, b, "yes" if a > 0 else "no") for a, b in data],
                               "a double, b double, label string")
    res = ML.sweep(df, "label")
    assert not res.errors and res.best_metric_value > 0.9
    with pytest.raises(ValueError):
        ML.sweep(df.limit(1), "label", task="classification")


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_forest_in_groups_of_trees(spark, monkeypatch, classes):
    """At most BAG_CELLS counts are kept; the groups add up to one forest of N_TREES."""
    from pyspark.ml.feature import VectorAssembler
    rnd = random.Random(6)
    data = [(rnd.random(), rnd.random()) for _ in range(400)]
    df = spark.createDataFrame([(a, b, float(int(a * classes) if classes else a)) for a, b in data],
                               "a double, b double, y double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol=ML.FEATURES).transform(df).withColumnRenamed("y", ML.LABEL)
    monkeypatch.setattr(ML, "BAG_CELLS", 400 * 40)
    forest = dict(ML._models("classification" if classes else "regression", classes, 400))["Random Forest"]
    model = forest.fit(ready)
    assert [m.getNumTrees for m in model.models] == [34, 33, 33]
    got = model.transform(ready).collect()
    assert len(got) == 400 and model.featureImportances[0] > 0.8
    assert sum(model.featureImportances) == pytest.approx(1.0)
    wrong = [abs(r["prediction"] - r[ML.LABEL]) for r in got]
    assert sum(wrong) / 400 < 0.05
    if classes:
        assert all(sum(r["rawPrediction"]) == pytest.approx(100) and len(r["rawPrediction"]) == classes for r in got)
    else:
        parts = [m.transform(ready).select("prediction").collect() for m in model.models]
        assert all(r["prediction"] == pytest.approx((34 * a[0] + 33 * b[0] + 33 * c[0]) / 100)
                   for r, a, b, c in zip(got, *parts, strict=True))


def test_csv_of_real_files(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('id,seat,text,at\n1,12D,"hello\nworld",2024-01-02T00:00:00.000\n'
                 '2,7F,"a,b",2024-01-02T10:00:00.500\n3,9D,c\n')
    df = CSV.read_csv_auto(spark, str(p))
    assert df.count() == 3 and dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["seat"] == "string"
    from tabsense.operators import clean as CL
    assert dict(CL.cast_dates(df, CL.detect_dates(df)).dtypes)["at"] == "timestamp_ntz"
    p.write_text("a,b\n1,2\n3,9D,x,EXTRA\n")
    with pytest.raises(ValueError):
        CSV.read_csv_auto(spark, str(p))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_sniff_and_types(spark, tmp_path, sep):
    text = sep.join(["id", "price", "flag", "name", "when"]) + "\n"
    text += sep.join(["1", "2.5", "True", '"a' + sep + 'b"', "2024-01-02"]) + "\n"
    text += sep.join(["2", "NA", "False", "c", "2024-01-03"]) + "\n"
    text += sep.join(["3", "4", "true", "N/A", "2024-01-04"]) + "\n"
    p = tmp_path / "f.csv"
    p.write_text(text, encoding="utf-8")
    assert CSV.sniff_delimiter(text) == sep
    df = CSV.read_csv_auto(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "price": "double", "flag": "boolean",
                               "name": "string", "when": "string"}
    assert df.where(F.col("name") == "a" + sep + "b").count() == 1


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() >= 0 and "cardinality" in df.columns
