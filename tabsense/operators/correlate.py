"""Correlation (C1-C2): pairwise-complete Pearson matrix in one aggregate."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import column_moments
from ..functions.types import col, normalize_missing, numeric_columns

MATRIX_SCHEMA = "col1 string, col2 string, r double"
STRONG_LIMIT = 0.3     # fixed values: |r| threshold and number of pairs reported
STRONG_TOP = 10


WIDE_COLUMNS = 40     # above this many numeric columns the matrix is computed as a Gramian


def correlation_matrix(df: DataFrame, columns: list[str] | None = None,
                       wide_columns: int = WIDE_COLUMNS) -> DataFrame:
    """C1 (long form): (col1, col2, r) for every ordered pair of numeric columns,
    diagonal included (1.0, or NULL for a constant column), pairwise-complete.
    Fewer than two numeric columns -> empty frame with the same schema.

    Two global aggregates (partial aggregation per task, no shuffle of the data):
    pass 1 gives per-column non-null count, mean and population std; pass 2
    sums centred products. For a pair of columns without NULLs one SUM per pair
    suffices (r = sum(dx*dy) / (n*sd_x*sd_y)); a pair touching a column with
    NULLs uses masked sums over the rows where both are present. Centring at the
    mean keeps the sums numerically stable; a zero deviation gives NULL."""
    df = normalize_missing(df)
    cols = numeric_columns(df) if columns is None else list(columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], MATRIX_SCHEMA)
    xs = [col(c).cast("double") for c in cols]
    mom = column_moments(df, cols, want=("n", "rows", "mean", "std_pop"))
    rows = mom[cols[0]]["rows"]
    n = [mom[c]["n"] for c in cols]
    mean = [mom[c]["mean"] for c in cols]
    sd = [mom[c]["std_pop"] for c in cols]
    dx = [(x - F.lit(mean[i])) if mean[i] is not None else F.lit(None).cast("double")
          for i, x in enumerate(xs)]
    if len(cols) > wide_columns:
        return _wide_matrix(df, cols, xs, dx, sd)
    aggs, exprs = [], {}
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            if n[i] == rows and n[j] == rows:
                aggs.append(F.sum(dx[i] * dx[j]).alias(f"p{i}_{j}"))
                den = rows * (sd[i] or 0.0) * (sd[j] or 0.0)
                exprs[(i, j)] = (F.col(f"p{i}_{j}") / F.lit(den)) if den > 0 else F.lit(None).cast("double")
            else:
                both = xs[i].isNotNull() & xs[j].isNotNull()
                a, b = F.when(both, dx[i]), F.when(both, dx[j])
                aggs.append(F.struct(F.count(a), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b),
                                     F.sum(a * b)).alias(f"p{i}_{j}"))
                m = F.col(f"p{i}_{j}")
                k = m["col1"].cast("double")
                cov = m["col6"] / k - (m["col2"] / k) * (m["col3"] / k)
                vx = m["col4"] / k - (m["col2"] / k) * (m["col2"] / k)
                vy = m["col5"] / k - (m["col3"] / k) * (m["col3"] / k)
                exprs[(i, j)] = F.when((k > 0) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    wide = df.agg(*aggs)
    entries = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            if i == j:
                r = F.lit(1.0 if sd[i] else None).cast("double")
            else:
                r = exprs[(min(i, j), max(i, j))]
            entries.append(F.struct(F.lit(cols[i]).alias("col1"), F.lit(cols[j]).alias("col2"),
                                    r.cast("double").alias("r")))
    return wide.select(F.inline(F.array(*entries)))


def _wide_matrix(df, cols, xs, dx, sd):
    """Wide inputs in one scan: with x the centred values (0 where missing) and m the
    mask of present ones, the pairwise-complete sums of every pair are entries of
    the four products m'm, x'm, (x*x)'m and x'x. Each task adds up its batches (4 k*k
    numbers), and the rows of the products are summed across tasks. The k x k result
    is the feature itself and is returned as a long frame."""
    k = len(cols)

    def products(batches):
        total = np.zeros((4, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        at = np.arange(4 * k)
        yield pa.record_batch([pa.array(at), pa.array(list(total.reshape(4 * k, k)),
                                                      pa.list_(pa.float64()))], ["i", "row"])

    sums = (df.select(*[d.alias(f"_c{i}") for i, d in enumerate(dx)])
            .mapInArrow(products, "i long, row array<double>")
            .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")))
    total = np.zeros((4 * k, k))
    for r in sums.collect():                       # 4 k*k numbers
        total[r["i"], r["j"]] = r["v"]
    n, s, ss, p = total.reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p / n - (s / n) * (s.T / n)
        vx = ss / n - (s / n) ** 2
        r = cov / np.sqrt(vx * vx.T)
    out = []
    for i in range(k):
        for j in range(k):
            good = sd[i] and sd[j] and n[i, j] and vx[i, j] > 0 and vx[j, i] > 0
            v = (1.0 if sd[i] else None) if i == j else (float(r[i, j]) if good else None)
            out.append((cols[i], cols[j], v))
    return df.sparkSession.createDataFrame(out, MATRIX_SCHEMA)


def strong_pairs(df: DataFrame, columns: list[str] | None = None,
                 matrix: DataFrame | None = None) -> DataFrame:
    """Pairs i < j (column order) with |round(r, 3)| > 0.3, strongest first,
    first 10 (a top-k report)."""
    df = normalize_missing(df)
    cols = numeric_columns(df) if columns is None else list(columns)
    m = correlation_matrix(df, cols) if matrix is None else matrix
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))]) if pos else None
    if order is None:
        return m
    m = m.withColumn("_i", order[F.col("col1")]).withColumn("_j", order[F.col("col2")])
    r3 = F.round("r", 3)
    return (m.where((F.col("_i") < F.col("_j")) & (F.abs(r3) > STRONG_LIMIT))
            .orderBy(F.abs(r3).desc(), "_i", "_j").limit(STRONG_TOP)
            .select("col1", "col2", r3.alias("r")))
