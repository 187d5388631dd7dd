"""Decision trees without a depth limit (M4).

A node of many rows is split by histograms: tasks count their Arrow batches per (node,
feature, bin), Spark adds the counts up, and the best border of each node comes back, one
row per node. The bins' borders are exact quantiles of the features. A node whose rows
fit one task is finished there in one go: all its levels at once per feature, by sorted
values, every midpoint between two values being a candidate. So a table below
``SMALL_ROWS`` rows gets the exact tree, and a larger one an exact tree below its top
levels; no level is left out.

Splits maximise the decrease of Gini impurity or variance; between equal ones the first
feature and then the smallest threshold wins. A node ends where its labels are equal or
no feature has two values.

Memory per task: ``CELL_BYTES`` of histograms, or the rows of a small node. A level of
large nodes is one pass as long as its histograms fit, so passes grow with the depth of
the large nodes and not with their number.
"""
from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage
from ..functions.quantiles import exact_quantiles

SMALL_ROWS = 100_000
BORDERS = 128              # quantile borders per feature in large nodes
CELL_BYTES = 64 << 20      # of the histograms that a task holds in a pass, which bounds its nodes
BROADCAST_BYTES = 32 << 20  # of finished subtrees that a prediction sends everywhere
TASKS = 2000               # most tasks that finish small nodes
LEAF = -1


# ---- one task ------------------------------------------------------------

def stats_of(y: np.ndarray, classes: int) -> np.ndarray:
    """Per row: one-hot class, or 1, y, y * y (``classes`` 0: regression)."""
    if classes:
        return (y[:, None] == np.arange(classes)).astype(float)
    return np.stack([np.ones(len(y)), y, y * y], axis=1)


def sizes_of(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def purity(stats: np.ndarray, classes: int) -> np.ndarray:
    """What a split maximises the sum of: squared counts, or the squared sum, by size."""
    n = np.maximum(sizes_of(stats, classes), 1e-300)
    return (stats * stats).sum(axis=-1) / n if classes else stats[..., 1] ** 2 / n


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. ``value``: class shares, or the mean."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.feature[at] != LEAF)):
            n = at[open_]
            low = x[open_, self.feature[n]] <= self.threshold[n]
            at[open_] = np.where(low, self.left[n], self.right[n])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as parts:
            return cls(**{k: parts[k] for k in parts.files})


def shares(stats: np.ndarray, classes: int) -> np.ndarray:
    n = sizes_of(stats, classes)[..., None]
    return stats / n if classes else stats[..., 1:2] / n


def _by_side(order: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows sorted by node, dealt out to the two sides of each node; their order within a
    side stays."""
    n = len(order)
    if not n:
        return order
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    rights = np.cumsum(right)
    before = np.repeat(rights[starts] - right[starts], sizes)       # rights of earlier nodes
    n_right = np.repeat(rights[starts + sizes - 1], sizes) - before
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    nth_right = rights - before - right                             # rights of the node up to here
    place = np.where(right, start + size - n_right + nth_right, np.arange(n) - nth_right)
    out = np.empty_like(order)
    out[place] = order
    return out


def _since(values: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Sums from each of ``opens`` up to each of ``ends``."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    return upto[ends + 1] - upto[opens]


def grow(x: np.ndarray, y: np.ndarray, classes: int,
         w: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """The whole tree of these rows (with weights ``w``), level by level, and each
    feature's decrease of impurity. Every feature is sorted once: a level deals its open rows out to the new
    nodes in that order, and looks at no row of an ended node."""
    n_features = x.shape[1]
    every = stats_of(y, classes) if w is None else stats_of(y, classes) * w[:, None]
    parts = [np.ascontiguousarray(every[:, k]) for k in range(every.shape[1])]
    known = [np.unique(x[:, j], return_inverse=True) for j in range(n_features)]
    orders = [np.argsort(rank, kind="stable") for _, rank in known]
    gains = np.zeros(n_features)
    columns: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    # rows of nodes by row number, and per feature the rows of mixed nodes by node and value
    rows, node_of, first = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    where, goes = np.empty(len(x), np.int64), np.empty(len(x), bool)
    while len(rows):
        m = int(node_of.max()) + 1
        total = np.stack([np.bincount(node_of, p[rows], m) for p in parts], axis=1)
        low, high = np.full(m, np.inf), np.full(m, -np.inf)
        np.minimum.at(low, node_of, y[rows])
        np.maximum.at(high, node_of, y[rows])
        best, feature = np.full(m, -np.inf), np.full(m, LEAF)
        threshold = np.zeros(m)
        where[rows] = node_of
        mixed = low < high
        orders = [o[mixed[where[o]]] for o in orders]
        for j in range(n_features):
            values, rank = known[j]
            order = orders[j]
            at, r = where[order], rank[order]
            ends = np.flatnonzero((at[1:] == at[:-1]) & (r[1:] != r[:-1]))
            if not len(ends):
                continue
            starts = np.searchsorted(at, np.arange(m))
            node = at[ends]
            opens = starts[node]
            if classes:
                left = np.empty((len(ends), len(parts)))
                for k, p in enumerate(parts):
                    left[:, k] = _since(p[order], ends, opens)
                score = purity(left, classes) + purity(total[node] - left, classes)
            else:       # sizes and sums of y alone
                n = ends - opens + 1.0 if w is None else _since(parts[0][order], ends, opens)
                s = _since(parts[1][order], ends, opens)
                score = s ** 2 / n + (total[:, 1][node] - s) ** 2 / (total[:, 0][node] - n)
            run = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(score, run)
            hit = np.flatnonzero(score == np.repeat(top, np.diff(np.concatenate([run, [len(ends)]]))))
            nodes, place = np.unique(node[hit], return_index=True)
            place = ends[hit[place]]
            better = top > best[nodes]
            nodes, place, top = nodes[better], place[better], top[better]
            best[nodes], feature[nodes] = top, j
            a, b = values[r[place]], values[r[place + 1]]
            middle = a / 2 + b / 2
            threshold[nodes] = np.where((middle >= a) & (middle < b), middle, a)
        split = feature != LEAF
        np.add.at(gains, feature[split], best[split] - purity(total[split], classes))
        child = np.full(m, -1)
        child[split] = first + m + 2 * np.arange(int(split.sum()))
        columns["feature"].append(feature)
        columns["threshold"].append(threshold)
        columns["left"].append(child)
        columns["right"].append(np.where(split, child + 1, -1))
        columns["value"].append(shares(total, classes))
        stays = split[node_of]
        rows, node_of = rows[stays], node_of[stays]
        right = x[rows, feature[node_of]] > threshold[node_of]
        goes[rows] = right
        open_ = [o[split[where[o]]] for o in orders]
        orders = [_by_side(o, where[o], goes[o]) for o in open_]
        node_of = child[node_of] - first - m + right
        first += m
    return Tree(**{k: np.concatenate(v) for k, v in columns.items()}), gains


# ---- large nodes ---------------------------------------------------------

@dataclass
class Top:
    """The levels grown by histograms: node -> (feature, threshold, left, right), leaves
    with their value, and the open nodes that are finished by one task each."""

    splits: dict[int, tuple[int, float, int, int]] = field(default_factory=dict)
    values: dict[int, list[float]] = field(default_factory=dict)
    count: int = 1

    def router(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows -> nodes, a level at a time: a row meets only the splits on its path."""
        feature = np.full(self.count, LEAF)
        threshold, left, right = np.zeros(self.count), np.zeros(self.count, int), np.zeros(self.count, int)
        for node, split in self.splits.items():
            feature[node], threshold[node], left[node], right[node] = split
        return Tree(feature, threshold, left, right, np.empty(0)).leaves


def matrix(column: pa.Array, n_features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)


def _histograms(rows: DataFrame, top: Top, nodes: list[int], borders: list[np.ndarray],
                classes: int) -> DataFrame:
    width = classes or 3
    names = ["node", "feature", "bin", "low", "high", *[f"s{k}" for k in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_of = np.full(top.count, -1)
        slot_of[nodes] = np.arange(len(nodes))
        route = top.router()
        cells = [len(nodes) * (len(b) + 1) for b in borders]
        sums = [[np.zeros(n) for _ in range(width)] for n in cells]
        low = [np.full(n, np.inf) for n in cells]
        high = [np.full(n, -np.inf) for n in cells]
        for batch in batches:
            x, y = matrix(batch[0], len(borders)), batch[1].to_numpy(zero_copy_only=False)
            at = slot_of[route(x)]
            w = batch[2].to_numpy(zero_copy_only=False)[at >= 0]
            x, y, at = x[at >= 0], y[at >= 0], at[at >= 0]
            s = [np.ascontiguousarray(k * w) for k in stats_of(y, classes).T]
            for j, b in enumerate(borders):
                values = np.ascontiguousarray(x[:, j])
                cell = at * (len(b) + 1) + np.searchsorted(b, values, side="left")
                for k in range(width):
                    np.add.at(sums[j][k], cell, s[k])
                np.minimum.at(low[j], cell, values)
                np.maximum.at(high[j], cell, values)
        for j, b in enumerate(borders):
            met = np.flatnonzero(low[j] <= high[j])
            a, cell = np.divmod(met, len(b) + 1)
            yield pa.record_batch([pa.array(np.array(nodes)[a]), pa.array(np.full(len(a), j)), pa.array(cell),
                                   pa.array(low[j][met]), pa.array(high[j][met]),
                                   *[pa.array(sums[j][k][met]) for k in range(width)]], names)

    schema = "node long, feature long, bin long, low double, high double, " + ", ".join(
        f"s{k} double" for k in range(width))
    return rows.select("x", "y", "w").mapInArrow(run, schema).groupBy("node", "feature", "bin").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])


_SPLIT = "node long, feature long, threshold double, gain double, n_left double, n_right double, " \
         "stats array<double>"


def _best_split(classes: int):
    width = classes or 3

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        """The best border of one node (at most features x bins rows)."""
        found, spread = (-math.inf, LEAF, 0.0, 0.0, 0.0), (0.0, LEAF, 0.0)
        for j, own in cells.sort_values(["feature", "bin"]).groupby("feature"):
            s = own[[f"s{k}" for k in range(width)]].to_numpy()
            low, high = own["low"].to_numpy(), own["high"].to_numpy()
            total = s.sum(axis=0)
            left = np.cumsum(s, axis=0)[:-1]
            if len(left):
                score = purity(left, classes) + purity(total - left, classes)
                k = int(np.argmax(score))
                if score[k] > found[0]:
                    n = float(sizes_of(left[k], classes))
                    # between the values on both sides, as in a small node
                    middle = high[k] / 2 + low[k + 1] / 2
                    middle = middle if high[k] <= middle < low[k + 1] else high[k]
                    found = (float(score[k]), int(j), middle, n, float(sizes_of(total, classes)) - n)
            elif high[0] > low[0] and spread[1] == LEAF:
                spread = (high[0] - low[0], int(j), low[0] / 2 + high[0] / 2)
        pure = np.count_nonzero(total) <= 1 if classes else \
            total[0] * total[2] - total[1] ** 2 <= 1e-12 * abs(total[0] * total[2])
        score, feature, threshold, n_left, n_right = found
        gain = max(0.0, score - float(purity(total, classes))) if feature != LEAF else 0.0
        if feature == LEAF and spread[1] != LEAF:  # all in one bin: halve its range
            feature, threshold = spread[1:]
            n_left = n_right = float(sizes_of(total, classes))   # at most
        if pure:
            feature = LEAF
        return pd.DataFrame([(cells["node"].iloc[0], feature, threshold, gain, n_left, n_right,
                              total.tolist())], columns=[c.split()[0] for c in _SPLIT.split(", ")])

    return run


@dataclass
class TreeModel:
    top: Top
    subtrees: DataFrame            # node, blob
    n_features: int
    classes: int
    importances: np.ndarray
    size: int                      # bytes of all blobs
    features_col: str
    label_col: str

    def values(self, df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """The label and ``value`` (class shares, or the mean) of every row. Subtrees
        of checked size go to all tasks; larger ones meet their rows sorted by node, so a
        task holds one of them at a time."""
        top, n_features = self.top, self.n_features
        rows = df.select(vector_to_array(self.features_col).alias("x"),
                         F.col(self.label_col).cast("double").alias("y"))
        if self.size <= broadcast_bytes:
            sent = df.sparkSession.sparkContext.broadcast(
                {r["node"]: bytes(r["blob"]) for r in self.subtrees.collect()})

            def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trees = {n: Tree.from_bytes(b) for n, b in sent.value.items()}
                to_node = top.router()
                for b in batches:
                    x = matrix(b[0], n_features)
                    yield pa.record_batch([b[1], _values(top, trees, to_node(x), x)], ["y", "value"])

            return rows.mapInArrow(small, "y double, value array<double>")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to_node = top.router()
            for b in batches:
                yield pa.record_batch([pa.array(to_node(matrix(b[0], n_features))), *b.columns],
                                      ["node", "x", "y"])

        def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees: dict[int, Tree] = {}
            for b in batches:
                node, kind = b[0].to_numpy(), b[1].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1])
                                                        | (kind[1:] != kind[:-1])])) if len(node) else []
                for i, j in zip(starts, [*starts[1:], len(node)], strict=True):
                    if kind[i] == 0:
                        trees = {int(node[i]): Tree.from_bytes(b[4][int(i)].as_py())}
                        continue
                    x = matrix(b[2].slice(i, j - i), n_features)
                    yield pa.record_batch([b[3].slice(i, j - i), _values(top, trees, node[i:j], x)],
                                          ["y", "value"])

        routed = rows.mapInArrow(route, "node long, x array<double>, y double")
        both = self.subtrees.select(
            "node", F.lit(0).alias("kind"), F.lit(None).cast("array<double>").alias("x"),
            F.lit(None).cast("double").alias("y"), "blob").unionByName(
            routed.select("node", F.lit(1).alias("kind"), "x", "y", F.lit(None).cast("binary").alias("blob")))
        return both.repartition("node").sortWithinPartitions("node", "kind") \
            .select("node", "kind", "x", "y", "blob").mapInArrow(streamed, "y double, value array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """The label, ``prediction`` and, for classes, ``rawPrediction`` (their shares)."""
        out = self.values(df).withColumnRenamed("y", self.label_col)
        if not self.classes:
            return out.select(self.label_col, F.col("value")[0].alias("prediction"))
        first = F.array_position("value", F.array_max("value")) - 1
        return out.select(self.label_col, first.cast("double").alias("prediction"),
                          array_to_vector("value").alias("rawPrediction"))

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        return Vectors.dense(self.importances)


def _values(top: Top, trees: dict[int, Tree], nodes: np.ndarray, x: np.ndarray) -> pa.Array:
    width = len(next(iter(top.values.values()), None) or next(iter(trees.values())).value[0])
    out = np.empty((len(x), width))
    order = np.argsort(nodes, kind="stable")
    cuts = np.flatnonzero(np.diff(nodes[order])) + 1
    for here in np.split(order, cuts) if len(order) else []:
        node = int(nodes[here[0]])
        out[here] = top.values[node] if node in top.values else trees[node].predict(x[here])
    cuts = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out.ravel()))


@dataclass
class DecisionTree:
    """Estimator in the manner of Spark ML; ``classes`` 0 fits a regression tree. A row of
    weight n stands for n equal rows, or for n rows of equal features and its mean label."""

    classes: int
    featuresCol: str
    labelCol: str
    small_rows: int = SMALL_ROWS
    borders: int = BORDERS
    weightCol: str | None = None

    def fit(self, train: DataFrame) -> TreeModel:
        rows = cut_lineage(train.select(vector_to_array(self.featuresCol).alias("x"),
                                        F.col(self.labelCol).cast("double").alias("y"),
                                        (F.col(self.weightCol) if self.weightCol else F.lit(1))
                                        .cast("double").alias("w")))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("f")).first()
        n, n_features, classes = size["n"], size["f"], self.classes
        if not n:
            raise ValueError("a tree needs rows")
        top, gains = Top(), np.zeros(n_features)
        large, finish = ([0], []) if n > self.small_rows else ([], [0])
        if large:
            probs = [k / (self.borders + 1) for k in range(1, self.borders + 1)]
            q = exact_quantiles(rows, {f"x{j}": F.col("x")[j] for j in range(n_features)}, probs)
            borders = [np.unique(q[f"x{j}"]) for j in range(n_features)]
            at_once = max(1, CELL_BYTES // sum(8 * ((classes or 3) + 2) * (len(b) + 1) for b in borders))
        while large:
            now, large = large[:at_once], large[at_once:]
            best = _histograms(rows, top, now, borders, classes).groupBy("node") \
                .applyInPandas(_best_split(classes), _SPLIT).orderBy("node").collect()
            for r in best:                     # one row per node
                if r["feature"] == LEAF:
                    top.values[r["node"]] = shares(np.array(r["stats"]), classes).tolist()
                    continue
                gains[r["feature"]] += r["gain"]
                children = top.count, top.count + 1
                top.splits[r["node"]] = (r["feature"], r["threshold"], *children)
                top.count += 2
                for child, size in zip(children, (r["n_left"], r["n_right"]), strict=True):
                    (large if size > self.small_rows else finish).append(child)
        subtrees, more = self._finished(rows, top, n_features)
        gains += more
        importances = gains / gains.sum() if gains.sum() > 0 else gains
        total = subtrees.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        return TreeModel(top, subtrees, n_features, classes, importances, total, self.featuresCol,
                         self.labelCol)

    def _finished(self, rows: DataFrame, top: Top, n_features: int) -> tuple[DataFrame, np.ndarray]:
        """The subtrees below the top, each from its node's rows in one task."""
        classes = self.classes

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ended = np.array([n in top.values for n in range(top.count)])
            to_node = top.router()
            for b in batches:
                at = to_node(matrix(b[0], n_features))
                open_ = pa.array(~ended[at])
                yield pa.record_batch([pa.array(at).filter(open_), *[c.filter(open_) for c in b.columns]],
                                      ["node", "x", "y", "w"])

        def finished(rows: pd.DataFrame) -> pd.DataFrame:
            w = rows["w"].to_numpy() if self.weightCol else None
            tree, gains = grow(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(), classes, w)
            return pd.DataFrame([(rows["node"].iloc[0], tree.to_bytes(), gains.tolist())],
                                columns=["node", "blob", "gains"])

        # a named number of partitions: few nodes of much work are not coalesced into few tasks
        open_nodes = max(1, top.count - len(top.splits) - len(top.values))
        found = cut_lineage(rows.mapInArrow(route, "node long, x array<double>, y double, w double")
                            .repartition(min(2 * open_nodes, TASKS), "node").groupBy("node").applyInPandas(finished, "node long, blob binary, gains array<double>"))
        sums = found.agg(*[F.sum(F.col("gains")[j]) for j in range(n_features)]).first()
        return found.select("node", "blob"), np.array([s or 0.0 for s in sums])
