"""Model sweep (F7, M1-M11): stable split, five Spark ML models per task,
leaderboard, feature importance, and exact metrics as aggregates.

Metrics are computed from a predictions frame with DataFrame aggregates only
(no collect of predictions): accuracy and weighted F1 from a confusion table,
ROC-AUC exactly (tie-aware Mann-Whitney form) from per-score counts and a
bucketed running sum, RMSE/MAE/R^2 in one aggregate.
"""
from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import agg_row, cut_lineage, keep
from ..functions.types import BOOLEAN, NUMERIC, col, logical_types, normalize_missing
from ..functions.windows import running_sum
from .features import SIDE
from .target import task_table
from .trees import SMALL_ROWS, DecisionTree

SEED = 42               # fixed values: split seed / share, forest size, iterations
TRAIN_PCT = 80
N_TREES = 100
LOGREG_MAX_ITER = 1000
TOP_FEATURES = 10
# chosen for a distributed fit: each level of a forest and each boosting round is a pass
# over the data, so depth 6 instead of unlimited and 20 rounds instead of 100; the single
# tree has no depth limit
TREE_DEPTH = 6
BOOST_ROUNDS = 20
BAG_CELLS = 600_000_000     # (row, tree) counts of a forest that Spark keeps at once: 4 bytes each
ROWS_AT_ONCE = 5_000_000    # above so many training rows one model is fitted at a time
CELLS = SMALL_ROWS          # ... and rows of at most so many feature vectors are fitted as weighted ones


# F7, M1 -----------------------------------------------------------------------
def prepare_xy(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Rows with a target; features = numeric and boolean columns but the target."""
    kinds = logical_types(df)
    feats = [c for c in df.columns if c not in (target, SIDE) and kinds[c] in (NUMERIC, BOOLEAN)]
    return df.na.drop(subset=[target]), feats


COPY_BLOCK = 10_000           # identical rows are numbered in blocks of so many


def with_side(df: DataFrame, seed: int = SEED, train_pct: int = TRAIN_PCT) -> DataFrame:
    """Adds the hidden column SIDE. A row's side comes from the md5 of its content
    and of its number among identical rows, so it is the same under any
    partitioning or retry, and copies are split like other rows. Take it before
    anything is fitted (scaling, encoding), as fitted values may differ in their
    last digits between runs; ``transform`` carries the column along.

    Identical rows are interchangeable: they are counted (copies collapse inside
    each map task) and dealt out again in blocks, so a hot row spreads over tasks."""
    cols = [col(c) for c in df.columns]
    text = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])
    n, block = "__tabsense_n", "__tabsense_block"
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    last = F.floor((F.col(n) - 1) / COPY_BLOCK)
    blocks = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    many = blocks.where(F.col(n) > COPY_BLOCK).repartition(block, *cols)
    spread = blocks.where(F.col(n) <= COPY_BLOCK).unionByName(many)
    start = F.col(block) * COPY_BLOCK
    dealt = spread.withColumn("__tabsense_copy", F.explode(F.sequence(
        start, F.least(F.col(n), start + COPY_BLOCK) - 1)))
    digest = F.md5(F.concat_ws("\u0001", text, F.col("__tabsense_copy").cast("string"),
                               F.lit(str(seed))))
    side = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < train_pct
    return dealt.select(*cols, side.alias(SIDE))


def split(df: DataFrame, seed: int = SEED, train_pct: int = TRAIN_PCT) -> tuple[DataFrame, DataFrame]:
    """80/20 split by ``with_side`` (or by the SIDE column that ``df`` brings along)."""
    tagged = df if SIDE in df.columns else with_side(df, seed, train_pct)
    return tagged.where(F.col(SIDE)).drop(SIDE), tagged.where(~F.col(SIDE)).drop(SIDE)


def split_sizes(df: DataFrame, seed: int = SEED) -> DataFrame:
    return with_side(df, seed).groupBy(F.when(F.col(SIDE), "train").otherwise("test").alias("side")).agg(
        F.count(F.lit(1)).alias("n"))


# M7, M8 -----------------------------------------------------------------------
def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = None, by: list[str] | None = None,
                           weight: str | None = None) -> DataFrame:
    """accuracy, weighted F1 (0 for a class never predicted right) and, when a
    score column is given and the labels are binary, exact ROC-AUC; per ``by``.
    ``weight``: the number of rows that a row stands for."""
    by = list(by or [])
    g = [col(b) for b in by]
    conf = pred.groupBy(*g, col(label).alias("_l"), col(prediction).alias("_p")).agg(
        (F.sum(col(weight)) if weight else F.count(F.lit(1))).alias("_n"))
    # per (group, class): support, true positives, predicted count
    sup = conf.groupBy(*g, F.col("_l").alias("_c")).agg(
        F.sum("_n").alias("support"), F.sum(F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)).alias("tp"))
    prd = conf.groupBy(*g, F.col("_p").alias("_c")).agg(F.sum("_n").alias("predicted"))
    cls = sup.join(prd, [*by, "_c"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    f1c = F.when(F.col("support") + F.col("predicted") > 0,
                 2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    out = cls.groupBy(*g).agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1c * F.col("support")), F.sum("support")).cast("double").alias("f1"),
        F.sum(F.when(F.col("support") > 0, 1).otherwise(0)).alias("_k"))
    if score is None:
        return out.drop("_k").withColumn("roc_auc", F.lit(None).cast("double"))
    auc = roc_auc(pred, label, score, by, weight)
    res = out.join(auc, by, "left") if by else _attach_row(out, auc)
    return res.select(*g, "accuracy", "f1",
                      F.when(F.col("_k") == 2, F.col("roc_auc")).alias("roc_auc"))


def _attach_row(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.first()
    return left.select("*", *[F.lit(r[c] if r is not None else None).cast(t).alias(c)
                              for c, t in right.dtypes])


def roc_auc(pred: DataFrame, label: str, score: str, by: list[str] | None = None,
            weight: str | None = None) -> DataFrame:
    """Exact ROC-AUC of a binary label (positive = the larger label value):
    sum over distinct scores of pos(s) * (neg(< s) + neg(s) / 2) / (P * N).

    Counting per distinct score is one aggregate; neg(< s) is a running sum
    over scores computed per score-range bucket (no single-task window)."""
    by = list(by or [])
    g = [col(b) for b in by]
    n = col(weight) if weight else F.lit(1)
    pos_value = pred.groupBy(*g).agg(F.max(col(label)).alias("_pos"))
    p = pred.join(pos_value, by, "left") if by else _attach_row(pred, pos_value)
    per = p.groupBy(*g, col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(col(label) == F.col("_pos"), n).otherwise(0)).alias("_pc"),
        F.sum(F.when(col(label) != F.col("_pos"), n).otherwise(0)).alias("_nc"))
    cum = running_sum(per, "_nc", "_s", by or None, out="_cn")
    return cum.groupBy(*g).agg(
        F.try_divide(F.sum(F.col("_pc") * (F.col("_cn") - F.col("_nc") + F.col("_nc") / 2.0)),
                     (F.sum("_pc") * F.sum("_nc")).cast("double")).cast("double").alias("roc_auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*[col(b) for b in (by or [])]).agg(*_errors(col(label), col(prediction)))


def _errors(label: Column, prediction: Column) -> list[Column]:
    e = prediction.cast("double") - label.cast("double")
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
            (1.0 - F.try_divide(F.sum(e * e), F.var_pop(label.cast("double")) * F.count(label))).alias("r2")]


# M10 --------------------------------------------------------------------------
def leaderboard(metrics: DataFrame, task: str, model_order: list[str] | None = None) -> DataFrame:
    """Rank rows by F1 desc (classification) or RMSE asc (regression); ties keep
    the model order. Failed models (NULL metric) go last."""
    order = F.col("model_no") if "model_no" in metrics.columns else F.lit(0)
    if model_order and "model_no" not in metrics.columns:
        order = F.create_map(*[x for i, m in enumerate(model_order) for x in (F.lit(m), F.lit(i))])[F.col("model")]
    key = F.col("f1").desc_nulls_last() if task == "classification" else F.col("rmse").asc_nulls_last()
    # a leaderboard has one row per model (five): a single ordered window is bounded
    w = Window.orderBy(key, order.asc())
    return metrics.withColumn("rank", F.row_number().over(w).cast("int"))


# M2-M6, M11 -------------------------------------------------------------------
FEATURES, LABEL = "_features", "_label"     # private names: never collide with user columns
WEIGHT, BAGS = "_weight", "_bags"
CELLS_A_TASK = 20_000


@dataclass
class Forest:
    """A forest fitted some trees at a time. Spark keeps every row with one count per tree
    over all levels, so a large table's forest is fitted in groups of trees, each with a
    seed of its own; a table of at most BAG_CELLS / N_TREES rows has one group."""

    estimator: RandomForestClassifier | RandomForestRegressor
    rows: int

    def fit(self, train: DataFrame):
        e = self.estimator
        most = max(1, min(N_TREES, BAG_CELLS // max(1, self.rows)))
        groups = -(-N_TREES // most)
        sizes = [N_TREES // groups + (g < N_TREES % groups) for g in range(groups)]
        models = [e.copy({e.numTrees: k, e.seed: SEED + g}).fit(train) for g, k in enumerate(sizes)]
        return models[0] if groups == 1 else ForestModel(models, sizes)


@dataclass
class ForestModel:
    """The trees of all groups as one forest: votes add up, means weigh by their trees."""

    models: list
    sizes: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        votes = isinstance(self.models[0], RandomForestClassificationModel)
        out, kept = df, df.columns
        for g, model in enumerate(self.models):
            m = model.copy().setPredictionCol(f"_prediction{g}")
            if votes:
                m = m.setRawPredictionCol(f"_votes{g}").setProbabilityCol("")
            out = m.transform(out)
        n = len(self.models)
        if not votes:
            mean = sum((F.col(f"_prediction{g}") * k for g, k in enumerate(self.sizes)), F.lit(0.0)) / sum(self.sizes)
            return out.select(*kept, mean.alias("prediction"))
        of = [vector_to_array(f"_votes{g}") for g in range(n)]
        out = out.select(*kept, F.array(*[sum((v[c] for v in of), F.lit(0.0))
                                          for c in range(self.models[0].numClasses)]).alias("_votes"))
        return out.select(*kept, (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
                          .alias("prediction"), array_to_vector("_votes").alias("rawPrediction"))

    @property
    def featureImportances(self):
        of = [m.featureImportances.toArray() * k for m, k in zip(self.models, self.sizes, strict=True)]
        return Vectors.dense(sum(of) / sum(self.sizes))


@dataclass
class CellForest:
    """A forest of the same trees from weighted rows with the column BAGS: a struct (w, y)
    per tree, the sum of the Poisson counts that a bootstrap deals to the rows which a row
    stands for, and their label. Spark deals one count to a row whatever its weight, so
    every tree is fitted by itself, on the weights of its bag."""

    estimator: RandomForestClassifier | RandomForestRegressor
    classes: int

    def fit(self, train: DataFrame):
        e = self.estimator
        some = "sqrt" if self.classes else "onethird"   # what "auto" means for several trees
        kind = {"ml_attr": {"type": "nominal", "num_vals": self.classes}} if self.classes else {}

        def one(t: int):
            bag = F.col(BAGS)[t]
            own = train.select(FEATURES, bag["w"].alias(WEIGHT), bag["y"].alias(LABEL, metadata=kind))
            return e.copy({e.numTrees: 1, e.bootstrap: False, e.featureSubsetStrategy: some,
                           e.weightCol: WEIGHT, e.seed: SEED + t}).fit(own.where(F.col(WEIGHT) > 0))

        with ThreadPoolExecutor(max_workers=8) as pool:
            return ForestModel(list(pool.map(one, range(N_TREES))), [1] * N_TREES)


def _models(task: str, classes: int = 0, rows: int = 0, weight: str | None = None):
    """The models by name; with ``weight`` for weighted rows, but for Huber Regression."""
    binary = classes == 2
    io = {"featuresCol": FEATURES, "labelCol": LABEL}
    if weight:
        return [(name, CellForest(est.estimator, classes) if isinstance(est, Forest) else est)
                for name, est in _weighted(_models(task, classes), weight)]
    if task == "classification":
        gbt = GBTClassifier(seed=SEED, maxIter=BOOST_ROUNDS, **io)
        svc = LinearSVC(maxIter=100, **io)
        return [
            ("Random Forest", Forest(RandomForestClassifier(numTrees=N_TREES, maxDepth=TREE_DEPTH, seed=SEED, **io), rows)),
            ("Gradient-Boosted Trees", gbt if binary else OneVsRest(classifier=gbt, **io)),
            ("Decision Tree", DecisionTree(classes, **io)),
            ("Logistic Regression", LogisticRegression(maxIter=LOGREG_MAX_ITER, **io)),
            ("Linear SVC", svc if binary else OneVsRest(classifier=svc, **io)),
        ]
    return [
        ("Random Forest", Forest(RandomForestRegressor(numTrees=N_TREES, maxDepth=TREE_DEPTH, seed=SEED, **io), rows)),
        ("Gradient-Boosted Trees", GBTRegressor(seed=SEED, maxIter=BOOST_ROUNDS, **io)),
        ("Decision Tree", DecisionTree(0, **io)),
        ("Linear Regression", LinearRegression(**io)),
        ("Huber Regression", LinearRegression(loss="huber", **io)),
    ]


def _weighted(models: list, weight: str) -> list:
    for name, est in models:
        if isinstance(est, DecisionTree):
            est.weightCol = weight
        elif name != "Huber Regression" and not isinstance(est, Forest):
            est.setWeightCol(weight)
    return models


def linear_fit(df: DataFrame, target: str, feature: str) -> DataFrame:
    """The sweep's linear regression on one feature over all rows: intercept, slope,
    |coefficient| as importance, and the fit's RMSE, MAE and R2."""
    data = normalize_missing(df).select(col(feature).cast("double").alias("x"),
                                        col(target).cast("double").alias(LABEL)).na.drop()
    ready = VectorAssembler(inputCols=["x"], outputCol=FEATURES).transform(data)
    model = dict(_models("regression"))["Linear Regression"].fit(ready)
    metrics = regression_metrics(model.transform(ready), LABEL, "prediction")
    (_, importance), = importances(model, [feature])
    return metrics.select(F.lit(float(model.intercept)).alias("intercept"),
                          F.lit(float(model.coefficients[0])).alias("slope"),
                          F.lit(importance).alias("importance"), "rmse", "mae", "r2")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or |coefficients| (first class row); top 10."""
    m = model
    if hasattr(m, "models") and getattr(m, "models", None):      # OneVsRest: first class model
        m = m.models[0]
    vals = None
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray()
    elif hasattr(m, "coefficientMatrix") and m.numClasses > 2:
        vals = abs(m.coefficientMatrix.toArray()[0])
    elif hasattr(m, "coefficients"):
        vals = abs(m.coefficients.toArray())
    if vals is None:
        return []
    pairs = sorted(zip(features, (float(v) for v in vals)), key=lambda t: t[1], reverse=True)
    return pairs[:TOP_FEATURES]


@dataclass
class SweepResult:
    task: str
    metric_name: str
    leaderboard: DataFrame
    best_model_name: str
    best_metric_value: float
    feature_importance: DataFrame
    errors: dict[str, str] = field(default_factory=dict)
    models: dict = field(default_factory=dict)


def sweep(df: DataFrame, target: str, task: str | None = None, parallelism: int = 5) -> SweepResult:
    """Train the five models of the task on the 80 % side, score the 20 % side."""
    spark = df.sparkSession
    task = task or task_table(df, [target]).first()["task"]
    data, feats = prepare_xy(normalize_missing(df), target)
    if SIDE not in data.columns:
        data = with_side(data)
    # read by the aggregate, the indexer and both sides: split and prepared once
    source = data = keep(data)
    # a missing feature is its training mean, and a flag says so: all five models accept it
    counts = [F.count_if(F.col(SIDE)).alias("train"), F.approx_count_distinct(
        F.xxhash64(*[col(c).cast("double") for c in feats]) if feats else F.lit(0)).alias("vectors")]
    found = agg_row(data, counts + [x for i, c in enumerate(feats) for x in (
        F.avg(F.when(F.col(SIDE), col(c).cast("double"))).alias(f"m{i}"),
        F.count_if(col(c).isNull()).alias(f"z{i}"))])
    means = [found[f"m{i}"] or 0.0 for i in range(len(feats))]
    holes = [found[f"z{i}"] for i in range(len(feats))]
    gaps = [c for i, c in enumerate(feats) if holes[i]]
    data = data.withColumns({f"{c}_missing": col(c).isNull().cast("int") for c in gaps})
    data = data.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(means[i]))
                             for i, c in enumerate(feats) if c in gaps})
    feats += [f"{c}_missing" for c in gaps]
    if feats and found["train"] > ROWS_AT_ONCE and found["vectors"] <= 0.9 * CELLS:
        results = _fit_cells(data, feats, target, task, parallelism)
        source.unpersist()
        return _ranked(spark, task, feats, results)
    assembler = VectorAssembler(inputCols=feats, outputCol=FEATURES, handleInvalid="error")
    if task == "classification":
        idx = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc")
        prep = Pipeline(stages=[idx, assembler]).fit(data)
        classes = len(prep.stages[0].labels)
    else:
        prep = Pipeline(stages=[assembler]).fit(data)
        classes = 0
    ready = prep.transform(data)
    if task != "classification":
        ready = ready.withColumn(LABEL, col(target).cast("double"))
    train, test = (keep(side) for side in split(ready.select(FEATURES, LABEL, SIDE)))
    sizes = [side.agg(F.count(F.lit(1)), F.count_distinct(LABEL)).first() for side in (train, test)]
    source.unpersist()      # both sides are kept now
    if not sizes[0][0] or not sizes[1][0]:
        raise ValueError(f"a side of the split is empty: {sizes[0][0]} training, {sizes[1][0]} test rows")
    if task == "classification" and sizes[0][1] < len(prep.stages[0].labels):
        raise ValueError("the training side lacks a class")
    models, binary = _models(task, classes, sizes[0][0]), classes == 2

    def fit_one(item):
        i, (name, est) = item
        try:
            model = est.fit(train)
            pred = model.transform(test)
            if task == "classification":
                if binary and "rawPrediction" in pred.columns:
                    # read several times (confusion table, scores): computed once
                    pred = keep(pred.select(LABEL, "prediction",
                                            vector_to_array("rawPrediction")[1].alias("_score")))
                    m = classification_metrics(pred, LABEL, "prediction", "_score").first()
                else:
                    m = classification_metrics(pred, LABEL, "prediction").first()
                row = (i, name, float(m["accuracy"]), float(m["f1"]),
                       None if m["roc_auc"] is None else float(m["roc_auc"]), None, None, None, None)
            else:
                m = regression_metrics(pred, LABEL, "prediction").first()
                row = (i, name, None, None, None, float(m["rmse"]), float(m["mae"]), float(m["r2"]), None)
            return row, model, None
        except Exception as e:  # one model failing skips that model; the error is recorded
            err = f"{type(e).__name__}: {str(e)[:200]}"
            return (i, name, None, None, None, None, None, None, err), None, err

    # the fits are independent Spark jobs; running them concurrently keeps the
    # executors busy when one fit alone cannot (as Spark ML tuning's parallelism). On a
    # large table one can, and the rows that each fit keeps would push one another out
    workers = max(1, parallelism) if sizes[0][0] <= ROWS_AT_ONCE else 1
    with ThreadPoolExecutor(max_workers=workers) as pool:
        results = list(pool.map(fit_one, enumerate(models)))
    train.unpersist()
    test.unpersist()
    return _ranked(spark, task, feats, results)


def _ranked(spark, task: str, feats: list[str], results: list[tuple]) -> SweepResult:
    """The leaderboard, and the importances of the best model; ``results``: per model its
    row, the model and its error."""
    metric, metric_name = ("f1", "F1-Score") if task == "classification" else ("rmse", "RMSE")
    errors = {row[1]: err for row, _, err in results if err}
    fitted = {row[1]: model for row, model, err in results if not err}
    board = spark.createDataFrame([row for row, _, _ in results],
                                  "model_no int, model string, accuracy double, f1 double, "
                                  "roc_auc double, rmse double, mae double, r2 double, error string")
    board = leaderboard(board, task)
    first = board.where("rank = 1").first()
    best, best_val = (first["model"], first[metric]) if fitted else ("", None)
    imp = importances(fitted[best], feats) if best else []
    imp_df = spark.createDataFrame([(r + 1, f, v) for r, (f, v) in enumerate(imp)],
                                   "rank int, feature string, importance double")
    best_value = round(best_val, 4) if best else 0.0
    return SweepResult(task, metric_name, board, best, best_value, imp_df, errors, fitted)


# few feature vectors ------------------------------------------------------------
# Of many rows with few feature vectors, the fits read the vectors: a vector with its
# number of rows and their mean label (per class: with its number of rows) has the same
# least squares, likelihood, hinge loss and impurity decreases as the rows themselves.
def _bagged_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, seed, n, y) -> (cell, bags): n rows of one label get Poisson(n) together."""
    for b in batches:
        seed, n, y = (c.to_pylist() for c in b.columns[1:])
        bags = [[{"w": float(w), "y": v} for w in
                 np.random.default_rng([SEED, s & (1 << 64) - 1]).poisson(k, N_TREES)]
                for s, k, v in zip(seed, n, y, strict=True)]
        yield pa.record_batch([b[0], pa.array(bags, BAG)], ["_id", BAGS])


BAG = pa.list_(pa.struct([("w", pa.float64()), ("y", pa.float64())]))


def _bagged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, y) -> (cell, w, s): per tree the sums of the rows' Poisson counts and of
    these times y. Counts of m rows are those of Poisson(m) draws from them."""
    rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
    place: dict[float, int] = {}
    sums = np.zeros((0, 2, N_TREES))
    for b in batches:
        cell, y = (c.to_numpy() for c in b.columns)
        known, own = np.unique(cell, return_inverse=True)
        m, k = len(cell), len(known)
        if not m:
            continue
        at = [place.setdefault(c, len(place)) for c in known.tolist()]
        if len(place) > len(sums):
            sums = np.concatenate([sums, np.zeros((len(place) + len(sums), 2, N_TREES))])
        for t in range(N_TREES):
            drawn = rng.integers(0, m, rng.poisson(m))
            of = own[drawn]
            sums[at, 0, t] += np.bincount(of, minlength=k)
            sums[at, 1, t] += np.bincount(of, y[drawn], k)
    cells = list(place)
    for i in range(0, len(cells), 1000):
        part = sums[i:min(i + 1000, len(cells))]
        yield pa.record_batch([pa.array(cells[i:i + 1000], pa.float64()),
                               *[pa.array(list(part[:, k]), pa.list_(pa.float64())) for k in (0, 1)]],
                              ["_id", "w", "s"])


def _fit_cells(data: DataFrame, feats: list[str], target: str, task: str, parallelism: int) -> list[tuple]:
    """Per model its leaderboard row, the model and its error, from the distinct feature
    vectors of each side. Huber Regression and the errors of regressions read the rows."""
    spark, xs = data.sparkSession, [f"_x{i}" for i in range(len(feats))]
    by_class = task == "classification"
    rows = data.select(SIDE, *[col(c).cast("double").alias(x) for c, x in zip(feats, xs, strict=True)],
                       (col(target) if by_class else col(target).cast("double")).alias("_y"))
    key = [SIDE, *xs, *(["_y"] if by_class else [])]
    cells = cut_lineage(rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias(WEIGHT), *([] if by_class else [F.avg("_y").alias("_y")])))
    # numbered after the checkpoint: a double holds the numbers of 2**20 partitions exactly
    # ... and in few partitions: the fits are many passes over a small table
    few = -(-cells.count() // CELLS_A_TASK)
    cells = cut_lineage(cells.withColumn("_id", F.monotonically_increasing_id().cast("double")).coalesce(few))
    assembler = VectorAssembler(inputCols=xs, outputCol=FEATURES, handleInvalid="error")
    classes = 0
    if by_class:
        index = StringIndexer(inputCol="_y", outputCol=LABEL, stringOrderType="alphabetAsc").fit(cells)
        classes = len(index.labels)
        ready = assembler.transform(index.transform(cells))
    else:
        ready = assembler.transform(cells).withColumn(LABEL, F.col("_y"))
    train = ready.where(F.col(SIDE))
    # models return the label beside the prediction: a test cell's label is its number
    truth = keep(ready.where(~F.col(SIDE)).select(FEATURES, *xs, F.col(LABEL).alias("_truth"), WEIGHT, "_id"))
    test = truth.select(FEATURES, F.col("_id").alias(LABEL))
    n_test, held = truth.count(), train.agg(F.count_distinct(LABEL)).first()[0]
    if not held or not n_test:
        raise ValueError(f"a side of the split is empty: {held and 'test' or 'training'}")
    if by_class and held < classes:
        raise ValueError("the training side lacks a class")
    bags = _bags(rows, train, xs, by_class)
    train = keep(train.join(bags, "_id").coalesce(few))
    lean = keep(train.drop(BAGS))
    binary = classes == 2
    models = _models(task, classes, weight=WEIGHT)

    def fit_one(item):
        i, (name, est) = item
        try:
            if name == "Huber Regression":
                own = assembler.transform(rows.where(F.col(SIDE))).select(FEATURES, F.col("_y").alias(LABEL))
            else:
                own = train if isinstance(est, CellForest) else lean
            model = est.fit(own)
            pred = model.transform(test)
            score = by_class and binary and "rawPrediction" in pred.columns
            found = cut_lineage(pred.select(
                F.col(LABEL).alias("_id"), "prediction",
                *([vector_to_array("rawPrediction")[1].alias("_score")] if score else [])))
            if not by_class:
                return (i, name), model, found
            m = classification_metrics(found.join(truth.drop(FEATURES), "_id"), "_truth", "prediction",
                                       "_score" if score else None, weight=WEIGHT).first()
            return (i, name, float(m["accuracy"]), float(m["f1"]),
                    None if m["roc_auc"] is None else float(m["roc_auc"]), None, None, None, None), model, None
        except Exception as e:  # one model failing skips that model; the error is recorded
            err = f"{type(e).__name__}: {str(e)[:200]}"
            return (i, name, None, None, None, None, None, None, err), None, err

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(fit_one, enumerate(models)))
    if not by_class:
        results = _with_errors(rows.where(~F.col(SIDE)), truth.select("_id", *xs), xs, results)
    for kept in (train, lean, truth):
        kept.unpersist()
    return results


def _bags(rows: DataFrame, train: DataFrame, xs: list[str], by_class: bool) -> DataFrame:
    """(_id, BAGS) of the training cells."""
    kind = f"_id double, {BAGS} array<struct<w: double, y: double>>"
    if by_class:
        seed = F.xxhash64(*xs, LABEL)
        return cut_lineage(train.select("_id", seed.alias("seed"), WEIGHT, LABEL).repartition(8, "_id")
                           .mapInArrow(_bagged_counts, kind))
    own = rows.where(F.col(SIDE)).join(F.broadcast(train.select("_id", *xs)), xs).select("_id", "_y")
    # ranges of cells, in which a cell of many rows is divided by its labels
    sums = own.repartitionByRange("_id", "_y").mapInArrow(
        _bagged_rows, "_id double, w array<double>, s array<double>")
    per = sums.select("_id", F.posexplode(F.arrays_zip("w", "s")).alias("t", "x")).groupBy("_id", "t").agg(
        F.sum("x.w").alias("w"), F.sum("x.s").alias("s"))
    pair = F.struct("t", F.col("w"), F.try_divide("s", "w").alias("y"))
    return cut_lineage(per.groupBy("_id").agg(F.transform(
        F.array_sort(F.collect_list(pair)), lambda v: F.struct(v["w"].alias("w"), v["y"].alias("y"))).alias(BAGS)))


def _with_errors(rows: DataFrame, cells: DataFrame, xs: list[str], results: list[tuple]) -> list[tuple]:
    """The results with the errors over the test rows: one pass for all models, whose
    predictions go to the rows by their features (at most CELLS vectors)."""
    fitted = [i for i, (row, _, found) in enumerate(results) if len(row) == 2]
    if not fitted:
        return results
    for i in fitted:
        cells = cells.join(results[i][2].select("_id", F.col("prediction").alias(f"_p{i}")), "_id")
    m = rows.join(F.broadcast(cells.drop("_id")), xs).agg(
        *[c.alias(f"{n}{i}") for i in fitted
          for n, c in zip(("rmse", "mae", "r2"), _errors(F.col("_y"), F.col(f"_p{i}")), strict=True)]).first()
    done = {i: (*results[i][0], None, None, None, float(m[f"rmse{i}"]), float(m[f"mae{i}"]),
                float(m[f"r2{i}"]), None) for i in fitted}
    return [(done[i], model, None) if i in done else (row, model, err)
            for i, (row, model, err) in enumerate(results)]
