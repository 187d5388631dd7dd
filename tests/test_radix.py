import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsense.functions import quantiles as Q
from tabsense.functions import radix
from tabsense.operators import charts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
def test_keys_keep_the_order(values):
    a = np.array(values)
    keys = radix.keys_of(a)
    assert [radix.value_of(k) for k in keys] == [v + 0.0 for v in values]
    for k in range(len(a)):
        assert ((keys < keys[k]) == (a < a[k])).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=2, max_size=30), st.integers(1, 16))
def test_bins_of_a_bracket(unsigned, bits):
    keys = np.array(unsigned, np.uint64)
    signed = sorted(int((keys ^ radix._SIGN).view(np.int64)[k]) for k in range(2))
    b = radix.Bracket(0, signed[0], signed[1])
    inside, bins = radix._bins(keys, *b.cut(bits))
    lo, hi = sorted(unsigned[:2])
    top = (lo ^ hi).bit_length()
    for k, u in enumerate(unsigned):
        assert inside[k] == (u >> top == lo >> top)
        if inside[k]:
            assert bins[k] == (u & (1 << top) - 1) >> max(0, top - bits) < 1 << bits


def test_six_passes_over_600_decades(spark):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    (got,), passes = radix.select_columns(df, [F.col("v")], probs)
    values.sort()
    for p, q in zip(probs, got, strict=True):
        h = (len(values) - 1) * p
        k = math.floor(h)
        lo, hi = values[k], values[min(k + 1, len(values) - 1)]
        assert q == (lo if h == k else lo + (h - k) * (hi - lo))
    assert passes <= 6


def test_more_columns_than_a_job_takes(spark, monkeypatch):
    monkeypatch.setattr(radix, "COLUMNS", 3)
    df = spark.range(101).select(*[(F.col("id") * (k - 2)).cast("double").alias(f"c{k}") for k in range(8)],
                                 F.lit(None).cast("double").alias("none"))
    got = Q.exact_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5])
    assert got["none"] == [None, None]
    assert [got[f"c{k}"] for k in range(8)] == [sorted([x * (k - 2) for x in range(101)])[25:51:25]
                                               for k in range(8)]


ROWS = [(g, random.Random(i).choice([1e-200, -3.5, 7.0, 1e200, float(i)]) if i % 6 else None)
        for i in range(4000) for g in [None if i % 3 == 0 else f"g{i % 11}"]]


@pytest.mark.parametrize("most", [Q.GROUPS, 2])
def test_groups_by_either_way(spark, monkeypatch, most):
    """The hot group is the null one; above ``most`` groups, value counts are used."""
    monkeypatch.setattr(Q, "GROUPS", most)
    df = spark.createDataFrame([*ROWS, ("empty", None), ("nan", float("nan"))],
                               "g string, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{k}"] for k in range(5)] + [r["n"]]
           for r in Q.grouped_quantiles(df, ["g"], F.col("v"), probs).collect()}
    for g in {g for g, _ in ROWS}:
        values = np.array([v for h, v in ROWS if h == g and v is not None])
        assert got[g][:5] == pytest.approx(np.quantile(values, probs).tolist()) and got[g][5] == len(values)
    assert set(got) == {g for g, _ in ROWS}
    box = {r["g"]: r for r in charts.box(df, "v", "g").collect()}
    assert set(box) == set(got)
    for g, r in box.items():
        values = np.array([v for h, v in ROWS if h == g and v is not None])
        lo, hi = (r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"]))
        assert (r["n"], r["n_outliers"]) == (len(values), int(((values < lo) | (values > hi)).sum()))
        assert r["lower_whisker"] == values[values >= lo].min()
        assert r["upper_whisker"] == values[values <= hi].max()


def test_cells_held_by_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(radix, "HELD", 50)
    df = spark.range(3000).select((F.col("id") % 40).cast("int").alias("series"),
                                  F.sin("id").alias("v")).coalesce(1)
    got, _ = radix.select_groups(df, 40, [0.5])
    want = {r["series"]: r["m"] for r in df.groupBy("series").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {i: q[0] for i, (_, q) in got.items()} == pytest.approx(want)
