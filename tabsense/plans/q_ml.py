"""Registered queries: model sweep, metrics, leaderboard."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import keep
from ..operators import features as FT
from ..operators import ml as ML
from .catalog import r6, r6sql, register, with_
from .variants import VARIANTS, table

register("target_not_null", with_("customer_nulls") + "SELECT * FROM customer_nulls WHERE c_acctbal IS NOT NULL")(
    lambda s, d: ML.prepare_xy(table(s, d, "customer_nulls"), "c_acctbal")[0])



def _split_sql(src: str, cols: list[str]) -> str:
    text = " || chr(1) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in cols)
    return (f"WITH r AS (SELECT {text} AS t, row_number() OVER (PARTITION BY {', '.join(cols)}) - 1 AS k FROM {src}), "
            "m AS (SELECT md5(t || chr(1) || CAST(k AS VARCHAR) || chr(1) || '42') AS h FROM r) "
            "SELECT CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS side, "
            "count(*) AS n FROM m GROUP BY 1")


# labels without their ids: four distinct rows, thousands of copies
for _key, _src, _cols in (("split_80_20", "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
                          ("split_80_20_copies", "labels", ["quality", "toxic"])):
    register(_key, _split_sql(_src, _cols))(
        lambda s, d, src=_src, cols=_cols: ML.split_sizes(table(s, d, src).select(*cols)))


def _cls_metrics_sql(src, by=None):
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    on = f"sup.{by} = prd.{by} AND " if by else ""
    pick = f"coalesce(sup.{by}, prd.{by}) AS {by}, " if by else ""
    return (with_(src) + f""", conf AS (SELECT {g}label, prediction, count(*) AS n FROM {src} GROUP BY ALL),
sup AS (SELECT {g}label AS c, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM conf GROUP BY {g}label),
prd AS (SELECT {g}prediction AS c, sum(n) AS predicted FROM conf GROUP BY {g}prediction),
cls AS (SELECT {pick}coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
        FROM sup FULL OUTER JOIN prd ON {on}sup.c = prd.c)
SELECT {g}{r6sql('sum(tp) / sum(support)')} AS accuracy,
       {r6sql('sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END * support) / sum(support)')} AS f1
FROM cls {gb}""")


_AUC = """, s AS (SELECT score, sum(CASE WHEN label = (SELECT max(label) FROM predictions) THEN 1 ELSE 0 END) AS pc,
               sum(CASE WHEN label <> (SELECT max(label) FROM predictions) THEN 1 ELSE 0 END) AS nc
        FROM predictions GROUP BY score),
c AS (SELECT *, sum(nc) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM s)
SELECT sum(pc * (cn - nc + nc / 2.0)) / (sum(pc) * sum(nc)) AS roc_auc FROM c"""
register("metrics_classification",
         "SELECT m.*, " + r6sql("a.roc_auc") + " AS roc_auc FROM (" + _cls_metrics_sql("predictions")
         + ") m, (" + with_("predictions") + _AUC + ") a")(
    lambda s, d: r6(ML.classification_metrics(table(s, d, "predictions"), "label", "prediction", "score")))

register("metrics_regression", with_("predictions_reg") +
         "SELECT " + r6sql("sqrt(avg(power(prediction - label, 2)))") + " AS rmse, "
         + r6sql("avg(abs(prediction - label))") + " AS mae, "
         + r6sql("1 - sum(power(prediction - label, 2)) / (var_pop(label) * count(label))") + " AS r2 FROM predictions_reg")(
    lambda s, d: r6(ML.regression_metrics(table(s, d, "predictions_reg"))))


def _leaderboard(s, d):
    p = table(s, d, "rule_predictions")
    m = ML.classification_metrics(p, "label", "prediction", by=["model_no", "model"]).drop("roc_auc")
    return r6(ML.leaderboard(m, "classification"))


register("leaderboard_order",
         "SELECT model_no, model, accuracy, f1, CAST(row_number() OVER (ORDER BY f1 DESC, model_no) AS INTEGER) AS rank FROM ("
         + _cls_metrics_sql("rule_predictions", "model_no") + ") x JOIN (SELECT DISTINCT model_no, model FROM ("
         + VARIANTS["rule_predictions"]
         + ")) n USING (model_no)")(_leaderboard)


# sweeps (rows-only: model training has no SQL oracle) ----------------------------
def _cls_sweep(s, d):
    # a target that the features tell, though not linearly: a large rebate on the quantity
    rebate = F.when(F.col("l_quantity") * F.col("l_discount") > 1.2, "large").otherwise("small")
    items = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag",
                                           "l_linestatus", rebate.alias("rebate"))
    tagged = keep(ML.with_side(items))      # read by every fit of the transformation
    found = ML.sweep(FT.transform(tagged, target="rebate"), "rebate")
    tagged.unpersist()
    return found


def _reg_sweep(s, d):
    items = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber",
                                           "l_extendedprice")
    return ML.sweep(items, "l_extendedprice", task="regression")


# linear regression has a closed form
_FIT = ("SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, "
        "regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem")
register("linear_regression_fit",
         f"WITH f AS ({_FIT}) SELECT round(any_value(a), 3) AS intercept, round(any_value(b), 3) AS slope, "
         "round(abs(any_value(b)), 3) AS importance, round(sqrt(avg(power(l_extendedprice - a - b * l_quantity, 2))), 3) AS rmse, "
         "round(avg(abs(l_extendedprice - a - b * l_quantity)), 3) AS mae, round(any_value(r2), 3) AS r2 FROM lineitem, f")(
    lambda s, d: (lambda df: df.select(*[F.round(c, 3).alias(c) for c in df.columns]))(
        ML.linear_fit(table(s, d, "lineitem"), "l_extendedprice", "l_quantity")))

register("ml_classification")(lambda s, d: _cls_sweep(s, d).leaderboard)
register("ml_regression")(lambda s, d: _reg_sweep(s, d).leaderboard)
register("feature_importance")(lambda s, d: _reg_sweep(s, d).feature_importance)
