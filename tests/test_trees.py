import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsense.operators import trees as T


def brute(x, y, classes):
    """Nested (feature, threshold, left, right) or leaf shares, one node at a time."""
    def score(s):
        return T.purity(T.stats_of(s, classes).sum(axis=0), classes)

    best = None
    if y.min() < y.max():
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for a, b in zip(values, values[1:], strict=False):
                low = x[:, j] <= a
                s = score(y[low]) + score(y[~low])
                if best is None or s > best[0]:
                    best = (s, j, a / 2 + b / 2)
    if best is None:
        return T.shares(T.stats_of(y, classes).sum(axis=0), classes).tolist()
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], brute(x[low], y[low], classes), brute(x[~low], y[~low], classes)


def nested(tree, at=0):
    if tree.feature[at] == T.LEAF:
        return tree.value[at].tolist()
    return (int(tree.feature[at]), float(tree.threshold[at]), nested(tree, tree.left[at]),
            nested(tree, tree.right[at]))


@pytest.mark.parametrize("classes", [0, 2, 4])
def test_grown_at_once_like_node_by_node(classes):
    rng = np.random.default_rng(classes)
    for n in (1, 2, 7, 60, 200):
        x = rng.integers(0, 9, (n, 4)) / 2.0
        x[:, 3] = 1.0
        y = rng.integers(0, classes or 50, n).astype(float)
        tree, gains = T.grow(x, y, classes)
        assert nested(tree) == brute(x, y, classes)
        assert gains[3] == 0 and (gains >= -1e-9).all()


def frame(spark, x, y, parts=5):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    names = [f"c{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, [*names, "label"]).repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="f").transform(df)


def xor(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, 3)) / 4.0
    return x, ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)


@pytest.mark.parametrize("small", [100_000, 50, 3])
def test_depth_is_unlimited(spark, small):
    """Fully grown: training rows come back exactly, with the top levels grown by
    histograms and without."""
    rng = np.random.default_rng(1)
    x = rng.permutation(2000).reshape(-1, 2).astype(float)
    y = rng.integers(0, 3, len(x)).astype(float)
    df = frame(spark, x, y)
    model = T.DecisionTree(3, "f", "label", small, borders=8).fit(df)
    pred = model.transform(df).select("label", "prediction").collect()
    assert len(pred) == len(x) and all(r.label == r.prediction for r in pred)
    assert model.importances.sum() == pytest.approx(1.0)
    assert (small < 1000) == bool(model.top.splits)


def test_small_table_is_the_exact_tree(spark):
    x, y = xor(300)
    df = frame(spark, x, y)
    model = T.DecisionTree(2, "f", "label").fit(df)
    assert nested(T.Tree.from_bytes(model.subtrees.first()["blob"])) == brute(x, y, 2)
    assert model.importances[2] < 0.05


def test_rows_meet_large_subtrees_by_node(spark):
    x, _ = xor(800, 5)
    y = x[:, 0] * 3 - x[:, 1] ** 2
    df = frame(spark, x, y)
    model = T.DecisionTree(0, "f", "label", small_rows=90, borders=16).fit(df)
    near, far = (sorted((r.y, r.value[0]) for r in model.values(df, n).collect()) for n in (1 << 30, 0))
    assert near == far and all(a == pytest.approx(b) for a, b in near)
    assert len(model.top.splits) >= 8


def test_passes_grow_with_levels_not_with_nodes(spark, monkeypatch):
    """A level of many large nodes is one pass, and a row meets only its path's splits."""
    rng = np.random.default_rng(8)
    x, y = rng.permutation(4000).reshape(-1, 2).astype(float), rng.integers(0, 2, 2000).astype(float)
    passes, one = [], T._histograms
    monkeypatch.setattr(T, "_histograms", lambda *a: passes.append(len(a[2])) or one(*a))
    top = T.DecisionTree(2, "f", "label", small_rows=6, borders=40).fit(frame(spark, x, y)).top
    level = {0: 1}
    for node in sorted(top.splits):
        level.update(dict.fromkeys(top.splits[node][2:], level[node] + 1))
    assert max(passes) > 64 and len(passes) <= max(level.values())
    at = top.router()(x)
    for row, node in zip(x[:50], at[:50], strict=True):
        here = 0
        while here in top.splits:
            feature, threshold, left, right = top.splits[here]
            here = left if row[feature] <= threshold else right
        assert here == node


def test_large_nodes_that_cannot_be_split(spark):
    """Equal rows beyond a task's size, and values that share one bin."""
    x = np.array([[1.0, 5.0]] * 300 + [[2.0, 5.0 + k * 1e-9] for k in range(20)] + [[3.0, 5.0]] * 5)
    y = np.array([0.0, 1.0] * 150 + [float(k % 2) for k in range(20)] + [1.0] * 5)
    df = frame(spark, x, y)
    model = T.DecisionTree(2, "f", "label", small_rows=4, borders=2).fit(df)
    got = {(round(r.label), round(r.prediction)) for r in model.transform(df).collect()}
    assert (1, 1) in got
    assert model.transform(df).where("label = 1 and prediction = 1").count() >= 15
    for case in (df.limit(0), ):
        with pytest.raises(ValueError):
            T.DecisionTree(2, "f", "label").fit(case)


def test_sweep_uses_it(spark):
    from tabsense.operators import ml
    df = spark.range(600).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"),
                                 (F.col("id") % 5).alias("c")) \
        .withColumn("y", ((F.col("a") > 3).cast("int") + (F.col("b") > 5).cast("int")) % 2)
    res = ml.sweep(df, "y", "classification")
    assert not res.errors
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert board["Decision Tree"]["f1"] == 1.0 and board["Decision Tree"]["roc_auc"] == 1.0
