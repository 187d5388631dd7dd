"""Sweeps whose rows have few feature vectors: the fits read the vectors."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsense.operators import ml as ML
from tabsense.operators import trees as T


@pytest.fixture
def boards(spark, monkeypatch):
    """The leaderboard from rows, the one from vectors, and the rows each model then reads."""
    def run(df, target, task, trees=8):
        monkeypatch.setattr(ML, "N_TREES", trees)
        df = df.persist()
        rows = ML.sweep(df, target, task)
        monkeypatch.setattr(ML, "ROWS_AT_ONCE", 0)
        models, read = ML._models, {}

        def seen(*a, **k):
            found = models(*a, **k)
            for name, est in found:
                monkeypatch.setattr(type(est), "fit", type(est).fit)
                est.fit = lambda x, e=est, n=name, o=type(est).fit: read.update({n: x.count()}) or o(e, x)
            return found

        monkeypatch.setattr(ML, "_models", seen)
        cells = ML.sweep(df, target, task)
        monkeypatch.setattr(ML, "_models", models)
        df.unpersist()
        assert not rows.errors and not cells.errors
        return (*({r["model"]: r for r in x.leaderboard.collect()} for x in (rows, cells)), read, rows, cells)

    return run


def test_regression_from_vectors(spark, boards):
    rnd = random.Random(5)
    data = [(float(a), float(b), None if i % 9 == 0 else float(c), 3.0 * a - b * c + rnd.gauss(0, 2))
            for i in range(3000) for a, b, c in [(rnd.randrange(6), rnd.randrange(5), rnd.randrange(4))]]
    df = spark.createDataFrame(data, "a double, b double, c double, y double")
    rows, cells, read, was, now = boards(df, "y", "regression")
    assert max(n for name, n in read.items() if name != "Huber Regression") <= 6 * 5 * 5 < read["Huber Regression"]
    for name in rows:
        near = 0.15 if name == "Random Forest" else 1e-6
        for metric in ("rmse", "mae", "r2"):
            assert cells[name][metric] == pytest.approx(rows[name][metric], rel=near), (name, metric)
    # a missing c is told by its mean as well as by its flag: either may take the split
    old, new = (dict(ML.importances(x.models["Decision Tree"], "abcd")) for x in (was, now))
    assert all(new[f] == pytest.approx(old[f], abs=0.01) for f in "abcd")


def test_classification_from_vectors(spark, boards):
    rnd = random.Random(6)
    data = [(a, b, c, "yes" if a * b + rnd.random() * 4 > 9 else "no")
            for a, b, c in ((rnd.randrange(7), rnd.randrange(6), rnd.randrange(3)) for _ in range(3000))]
    df = spark.createDataFrame(data, "a int, b int, c int, y string")
    rows, cells, read, _, _ = boards(df, "y", "classification")
    assert max(read.values()) <= 2 * 7 * 6 * 3
    for name in rows:
        near = {"Random Forest": 0.03, "Gradient-Boosted Trees": 0.01, "Linear SVC": 0.01}.get(name, 1e-3)
        for metric in ("accuracy", "f1", "roc_auc"):
            assert cells[name][metric] == pytest.approx(rows[name][metric], rel=near), (name, metric)


def test_many_vectors_stay_rows(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") * 1.5).alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    monkeypatch.setattr(ML, "ROWS_AT_ONCE", 0)
    monkeypatch.setattr(ML, "CELLS", 100)
    monkeypatch.setattr(ML, "N_TREES", 2)
    monkeypatch.setattr(ML, "_fit_cells", None)
    assert not ML.sweep(df, "y", "regression").errors


@pytest.mark.parametrize("classes", [0, 3])
def test_weighted_tree_is_that_of_repeated_rows(classes):
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(1, 5, 60)
    y = rng.integers(0, classes or 40, 60).astype(float)
    one, gains = T.grow(x, y, classes, w.astype(float))
    many, same = T.grow(np.repeat(x, w, axis=0), np.repeat(y, w), classes)
    assert np.allclose(one.predict(x), many.predict(x)) and gains.sum() == pytest.approx(same.sum())


def test_bags_are_poisson_counts(monkeypatch):
    class Task:
        def partitionId(self):
            return 4

    monkeypatch.setattr(ML.TaskContext, "get", staticmethod(Task))
    cell = np.repeat([5.0, 7.0, 9.0], [1, 40, 2000])
    batches = [pa.record_batch([pa.array(cell[i::2]), pa.array(cell[i::2] * 10)], ["_id", "_y"]) for i in (0, 1)]
    out = pa.Table.from_batches(list(ML._bagged_rows(iter(batches)))).to_pydict()
    for c, w, s in zip(out["_id"], out["w"], out["s"], strict=True):
        n = (cell == c).sum()
        assert len(w) == ML.N_TREES and np.allclose(s, np.array(w) * c * 10)
        assert abs(np.mean(w) - n) < 5 * (n / ML.N_TREES) ** 0.5 and np.var(w) / n == pytest.approx(1, abs=0.6)
    counts = pa.record_batch([pa.array([1.0]), pa.array([-3]), pa.array([50]), pa.array([1.0])],
                             ["_id", "seed", "n", "y"])
    bags = next(ML._bagged_counts(iter([counts])))[1].to_pylist()[0]
    assert {b["y"] for b in bags} == {1.0} and abs(np.mean([b["w"] for b in bags]) - 50) < 4
