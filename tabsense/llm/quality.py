"""Quality rules by robust multivariate outliers.

Every document gets six counts and four transformed statistics. Per (language,
source) the regularised minimum-covariance-determinant estimate of their centre
and scatter is found by concentration steps from two deterministic starts, until
no determinant falls; documents whose Mahalanobis distance exceeds a chi-square
quantile are rejected. Everything is DataFrame expressions: the text is read once,
the steps run on a narrow table of statistics, groups are only ever aggregated
(partial sums and bounded quantile sketches), so one group may hold any share of
the rows.

Most texts have no symbols and repeat nothing, so a group's robust scatter of
three statistics is often zero. What regularises it are the sampling variances of
the counts themselves (``variances``), not fixed widths: the group's median in the
steps, and at least the document's own when it is judged, since one symbol among
ten words tells less than a hundred among a thousand.

Defined cases: a null or empty text has no words, fails the base rule and is not
kept; null language or source is a group of its own; repeated rows count as
often as they occur and all get the same verdict; an empty table gives an empty
result; other columns of the input are not read.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, pick, text_or_empty

WINDOW = 5
STATS = ["x0", "x1", "x2", "x3"]
D = len(STATS)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
STARTS = ["a", "b"]
SALTS = 64  # parts of a group's rows in joins with its estimates
FALL = 1e-6  # a log determinant that falls by less does not fall


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_lines, n_dup_lines
    and n_repeat_words. Words are runs without ASCII white space; repeated
    5-word windows are recognised by their 64-bit hashes inside one document,
    without any shuffle."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("_t"))
    df = df.select(
        *keep,
        F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"),
                 lambda s: F.length(F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("_l"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    # one hash per window start; `_w` is used often, so it is materialised once
    starts = F.when(F.size("_w") >= WINDOW, F.sequence(F.lit(0), F.size("_w") - WINDOW)) \
        .otherwise(F.expr("cast(array() as array<int>)"))
    df = df.select(
        *keep, "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(
            *[F.get(F.col("_w"), i + k) for k in range(WINDOW)])).alias("_h"))
    repeated = F.size("_h") > F.size(F.array_distinct("_h"))
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    df = df.withColumn("_s", F.when(repeated, F.array_sort(F.transform(
        F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    twice = F.filter(
        F.transform(F.col("_s"), lambda x, k: F.when(
            (x["h"] == F.get(F.col("_s"), k - 1)["h"]) | (x["h"] == F.get(F.col("_s"), k + 1)["h"]),
            x["i"])), lambda i: i.isNotNull())
    covered = F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"),
                                (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", covered).drop("_h", "_s")


def transformed() -> list[Column]:
    """Log word length and square roots of symbol, duplicate-line and
    repeated-word shares: each roughly symmetric on ordinary text."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("x0"),
        F.sqrt(F.col("n_symbols") / words).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x3"),
    ]


def variances() -> list[Column]:
    """Sampling variance of each statistic in a text of this length: the root of a
    count of independent events has variance 1/4. Events are words, symbols, lines
    and windows said twice."""
    words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines"))
    return [(0.25 / words).alias("r0"), (0.25 / words).alias("r1"),
            (0.25 / lines).alias("r2"), (0.25 * 2 * WINDOW / words).alias("r3")]


def _factored(est: DataFrame, starts: list[str]) -> DataFrame:
    """Cholesky factor of scatter + variances f<i> per start; columns
    l_<start><i><j>. Built column by column: each entry uses the ones before it by
    name, so expressions stay short."""
    for t in starts:
        for i in range(D):
            for j in range(i + 1):
                rest = F.col(f"s_{t}{i}{j}") + (F.col(f"f{i}") if i == j else 0.0)
                for k in range(j):
                    rest = rest - F.col(f"l_{t}{i}{k}") * F.col(f"l_{t}{j}{k}")
                value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j \
                    else rest / F.col(f"l_{t}{j}{j}")
                est = est.withColumn(f"l_{t}{i}{j}", value)
    return est


def _distance(t: str) -> list[tuple[str, Column]]:
    """Forward substitution: named steps whose last is the squared distance."""
    steps, names = [], []
    for i in range(D):
        rest = F.col(STATS[i]) - F.col(f"m_{t}{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{t}{i}{k}") * F.col(f"y_{t}{k}")
        steps.append((f"y_{t}{i}", rest / F.col(f"l_{t}{i}{i}")))
        names.append(f"y_{t}{i}")
    total = reduce(lambda a, b: a + b, [F.col(n) * F.col(n) for n in names])
    return [*steps, (f"d_{t}", total)]


def _salted(est: DataFrame) -> DataFrame:
    """One copy of a group's estimates for each part of its rows."""
    return est.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_distances(df: DataFrame, starts: list[str]) -> DataFrame:
    for t in starts:
        for name, value in _distance(t):
            df = df.withColumn(name, value)
    return df


def _moments(t: str, inside: Column) -> list[Column]:
    out = [F.sum(F.when(inside, 1.0)).alias(f"n_{t}")]
    out += [F.sum(F.when(inside, F.col(x))).alias(f"u_{t}{i}") for i, x in enumerate(STATS)]
    return out + [F.sum(F.when(inside, F.col(STATS[i]) * F.col(STATS[j]))).alias(f"v_{t}{i}{j}")
                  for i, j in PAIRS]


def _estimates(agg: DataFrame, starts: list[str], factor: float) -> DataFrame:
    """Centre, scatter (times ``factor``), factor and log determinant g_<start>."""
    cols = [F.col("grp"), *[F.col(f"f{i}") for i in range(D)]]
    for t in starts:
        n = F.col(f"n_{t}")
        cols += [(F.col(f"u_{t}{i}") / n).alias(f"m_{t}{i}") for i in range(D)]
        cols += [((F.col(f"v_{t}{i}{j}") / n - F.col(f"u_{t}{i}") * F.col(f"u_{t}{j}") / n / n)
                  * factor).alias(f"s_{t}{i}{j}") for i, j in PAIRS]
    est = _factored(agg.select(*cols), starts)
    for t in starts:
        est = est.withColumn(f"g_{t}", 2 * reduce(lambda a, b: a + b, [
            F.log(F.col(f"l_{t}{i}{i}")) for i in range(D)]))
    return est


def mcd(rows: DataFrame, share: float = 0.75, accuracy: int = 1000) -> DataFrame:
    """Regularised minimum-covariance-determinant estimate per ``grp`` over columns
    x0..x3 of rows (grp, salt, x0.., r0..): one row per group with centre m_a0..,
    scatter s_a00.. and variances f0.. of the start whose final scatter + variances
    has the smaller determinant. The share-quantile of the distances comes from a
    bounded sketch per group. A start keeps its last estimate as soon as a step does
    not lower its determinant; the steps end when all have."""
    # makes the scatter of the inner share consistent with a normal distribution
    factor = share / chi2_cdf(chi2_quantile(share, D), D + 2)
    med = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, accuracy).alias(f"c{i}")
                                    for i, x in enumerate(STATS)],
                                  *[F.percentile_approx(f"r{i}", 0.5, accuracy).alias(f"f{i}")
                                    for i in range(D)])
    med = cut_lineage(med)
    centred = rows.join(_salted(med), ["grp", "salt"])
    for i, x in enumerate(STATS):
        centred = centred.withColumn(f"e{i}", (F.col(x) - F.col(f"c{i}")) / F.sqrt(f"f{i}"))
    norm = F.greatest(reduce(lambda a, b: a + b, [F.col(f"e{i}") ** 2 for i in range(D)]),
                      F.lit(1e-6))
    first = centred.withColumn("_q", norm).groupBy("grp").agg(
        *[F.first(f"{c}{i}").alias(f"{c}{i}") for c in "cf" for i in range(D)],
        *[F.percentile_approx(F.abs(F.col(f"e{i}")), 0.5, accuracy).alias(f"w{i}")
          for i in range(D)],
        *[F.avg(F.col(f"e{i}") * F.col(f"e{j}") / F.col("_q")).alias(f"z{i}{j}")
          for i, j in PAIRS])
    # start a: medians and 1.4826 MAD; start b: medians and the sign covariance
    est = first.select(
        "grp", *[f"f{i}" for i in range(D)],
        *[F.col(f"c{i}").alias(f"m_{t}{i}") for t in STARTS for i in range(D)],
        *[((F.col(f"w{i}") * 1.4826) ** 2 * F.col(f"f{i}") if i == j else F.lit(0.0))
          .alias(f"s_a{i}{j}") for i, j in PAIRS],
        *[(F.col(f"z{i}{j}") * D * F.sqrt(F.col(f"f{i}") * F.col(f"f{j}"))).alias(f"s_b{i}{j}")
          for i, j in PAIRS])
    est = _factored(est, STARTS)
    # the starts are no scatter of any rows: the first step always counts
    for t in STARTS:
        est = est.withColumn(f"g_{t}", F.lit(math.inf)).withColumn(f"falls_{t}", F.lit(True))
    est = cut_lineage(est)
    parts = {t: [f"m_{t}{i}" for i in range(D)] + [f"{c}_{t}{i}{j}" for c in "sl" for i, j in PAIRS]
             + [f"g_{t}"] for t in STARTS}
    moving = reduce(lambda a, b: a | b, [F.col(f"falls_{t}") for t in STARTS])
    while not est.filter(moving).isEmpty():
        near = _with_distances(rows.join(_salted(est.filter(moving)), ["grp", "salt"]), STARTS) \
            .select("grp", "salt", *STATS, *[f"f{i}" for i in range(D)],
                    *[f"d_{t}" for t in STARTS])
        cut = near.groupBy("grp").agg(*[F.percentile_approx(f"d_{t}", share, accuracy)
                                        .alias(f"k_{t}") for t in STARTS])
        inside = near.join(_salted(cut), ["grp", "salt"]).groupBy("grp").agg(
            *[F.first(f"f{i}").alias(f"f{i}") for i in range(D)],
            *[c for t in STARTS for c in _moments(t, F.col(f"d_{t}") <= F.col(f"k_{t}"))])
        new = _estimates(inside, STARTS, factor)
        new = new.select("grp", *[F.col(c).alias(f"new_{c}") for t in STARTS for c in parts[t]])
        falls = {t: F.coalesce(F.col(f"new_g_{t}") < F.col(f"g_{t}") - FALL, F.lit(False))
                 for t in STARTS}
        est = cut_lineage(est.join(new, "grp", "left").select(
            "grp", *[f"f{i}" for i in range(D)],
            *[F.when(falls[t], F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
              for t in STARTS for c in parts[t]],
            *[falls[t].alias(f"falls_{t}") for t in STARTS]))
    better = F.col("g_a") <= F.col("g_b")
    names = [f"m_{{}}{i}" for i in range(D)] + [f"s_{{}}{i}{j}" for i, j in PAIRS]
    return est.select("grp", *[f"f{i}" for i in range(D)],
                      *[F.when(better, F.col(n.format("a"))).otherwise(F.col(n.format("b")))
                        .alias(n.format("a")) for n in names])


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.75,
            quantile: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, text_hash,
    distance (null where the base rule fails) and kept."""
    body = F.col(f"`{text}`").cast("string")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("_text"),
                        F.to_json(F.struct(F.col("lang"), F.col("source"))).alias("grp"),
                        F.xxhash64(body).alias("text_hash"),
                        F.pmod(F.xxhash64(F.lit("salt"), F.col(f"`{doc_id}`"), body),
                               F.lit(SALTS)).cast("int").alias("salt"))
    stats = text_counts(keyed, ["doc_id", "grp", "text_hash", "salt"], "_text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10)
                             | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    stats = cut_lineage(stats.select("*", *transformed(), *variances()))
    good = stats.filter(~F.col("base_failed"))
    own = [f"r{i}" for i in range(D)]
    est = mcd(good.select("grp", "salt", *STATS, *own), share)
    judged = good.join(_salted(est), ["grp", "salt"])
    for i, r in enumerate(own):
        judged = judged.withColumn(f"f{i}", F.greatest(F.col(f"f{i}"), F.col(r)))
    judged = _with_distances(_factored(judged, ["a"]), ["a"]).withColumn("distance", F.col("d_a"))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "text_hash"]
    failed = stats.filter("base_failed").select(
        *cols, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.select(*cols, "distance",
                         (F.col("distance") <= chi2_quantile(quantile, D)).alias("kept")) \
        .unionByName(failed)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged. Rows are matched
    by id (null is an id like others) and text."""
    gone = quality(docs).filter("not kept") \
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id"))
                     & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")
