"""Differential tests: the same statistics computed with plain pandas/numpy on
sf0.001 tables (independent code written for the tests) versus the operators."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import clean as CL
from tabsense.operators import correlate as CR
from tabsense.operators import features as FT
from tabsense.operators import profile as P
from tabsense.plans.variants import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customer_nulls(spark):
    df = table(spark, SF, "customer_nulls")
    return df, df.toPandas()


def test_profile_vs_pandas(customer_nulls):
    df, pdf = customer_nulls
    got = {r["column"]: r for r in P.profile_schema(df).collect()}
    for c in pdf.columns:
        assert got[c]["null_count"] == int(pdf[c].isna().sum())
        assert got[c]["cardinality"] == int(pdf[c].nunique(dropna=False))
        assert got[c]["null_percentage"] == pytest.approx(pdf[c].isna().mean() * 100)


def test_health_vs_pandas(spark):
    df = table(spark, SF, "events_dups")
    pdf = df.toPandas()
    cells = pdf.shape[0] * pdf.shape[1]
    null_pct = pdf.isna().to_numpy().sum() / cells * 100
    dup_pct = pdf.duplicated().mean() * 100
    shares = [pdf[c].value_counts(normalize=True).max() * 100 for c in pdf.columns if pdf[c].notna().any()]
    dom_pct = sum(s > 95 for s in shares) / pdf.shape[1] * 100
    expect = round(min(100.0, max(0.0, 100 - (0.5 * null_pct + 0.3 * dup_pct + 0.2 * dom_pct))), 2)
    assert P.health_components(df).first()["health_score"] == pytest.approx(expect, abs=0.011)


def _g1(x: np.ndarray) -> float:
    d = x - x.mean()
    m2 = (d ** 2).mean()
    return float("nan") if m2 == 0 else float((d ** 3).mean() / m2 ** 1.5)


def test_clean_vs_pandas(spark):
    df = table(spark, SF, "events_nulls")
    pdf = df.toPandas()
    res = CL.clean(df, order_by="event_id")
    out = res.df.toPandas().sort_values("event_id").reset_index(drop=True)
    # independent recomputation
    e = pdf.copy()
    for c in ("event_type", "props"):
        e[c] = e[c].str.strip().str.lower()
    e = e.drop_duplicates()
    v = e["value"].dropna().to_numpy()
    g = _g1(v)
    fill = np.median(v) if (np.isnan(g) or abs(g) > 0.5) else v.mean()
    e["value"] = e["value"].fillna(fill)
    e = e.sort_values("event_id")
    e["ts"] = e["ts"].ffill().bfill()
    for c in ("event_id", "user_id", "value"):
        x = e[c].astype(float)
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        e[c] = x.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    e = e.reset_index(drop=True)
    for c in ("event_id", "user_id", "value"):
        np.testing.assert_allclose(out[c].to_numpy(), e[c].to_numpy(), rtol=1e-12)
    assert (out["event_type"] == e["event_type"]).all() and (out["props"] == e["props"]).all()
    assert (pd.to_datetime(out["ts"]) == pd.to_datetime(e["ts"])).all()


def test_correlation_vs_pandas(customer_nulls):
    df, pdf = customer_nulls
    nums = ["c_custkey", "c_nationkey", "c_acctbal"]
    expect = pdf[nums].astype(float).corr()
    for r in CR.correlation_matrix(df).collect():
        assert r["r"] == pytest.approx(expect.loc[r["col1"], r["col2"]], abs=1e-9)


def test_transform_vs_pandas(spark):
    df = table(spark, SF, "orders")
    pdf = df.toPandas()
    out = FT.transform(df).toPandas().sort_values("o_orderkey").reset_index(drop=True)
    base = pdf.sort_values("o_orderkey").reset_index(drop=True)
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        x = base[c].astype(float)
        z = (x - x.mean()) / x.std(ddof=0)
        # rows sorted by the original key; the scaled key keeps that order
        np.testing.assert_allclose(np.sort(out[c].to_numpy()) if c == "o_orderkey" else out[c].to_numpy(),
                                   np.sort(z.to_numpy()) if c == "o_orderkey" else z.to_numpy(), rtol=1e-9)
    dummies = pd.get_dummies(base[["o_orderstatus", "o_orderpriority"]], drop_first=True)
    for c in dummies.columns:
        assert (out[c].to_numpy() == dummies[c].to_numpy()).all()
    assert (out["o_orderdate_year"].to_numpy() == pd.to_datetime(base["o_orderdate"]).dt.year.to_numpy()).all()
