"""Ad-hoc queries (F5, Q1-Q9) from a declarative ``QuerySpec``.

The reference evaluates free Python expressions; here a question becomes a
JSON-able spec whose fields map onto DataFrame operators (filter, projection,
group-by aggregate, pivot, time buckets, melt, sort/top-k) or a SQL text over
the table. Every field is validated against the schema before the plan is built.
"""
from __future__ import annotations

import datetime as _dt
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.types import CATEGORICAL, NUMERIC, col, logical_types, normalize_missing

# Aggregate names accepted in a spec and what they compute.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "nunique": F.count_distinct, "median": F.median, "std": F.stddev_samp,
}
RESAMPLE_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


class QueryError(ValueError):
    pass


@dataclass
class QuerySpec:
    filter: str | None = None                    # SQL boolean expression
    select: list[str] | None = None              # columns or SQL expressions
    group_by: list[str] | None = None
    aggregations: list[list[str]] | None = None  # [[column, fn, alias], ...]
    pivot: dict | None = None                    # {"column": c, "values": [...]} (values optional)
    resample: dict | None = None                 # {"time": c, "unit": "month"}
    melt: dict | None = None                     # {"ids": [...], "values": [...], "var_name", "value_name"}
    order_by: list[list] | None = None           # [[column, "asc"|"desc"], ...]
    limit: int | None = None
    sql: str | None = None                       # SELECT over {df}
    chart_type: str | None = None
    chart_config: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "QuerySpec":
        return cls(**json.loads(text))


def _check_cols(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise QueryError(f"unknown columns {missing}")


def _grouped(df: DataFrame, keys: list[tuple[str, Column]], spec: QuerySpec) -> DataFrame:
    """Group-by aggregate over (output name, key expression) pairs. Medians are
    computed exactly and fully distributed by ``grouped_quantiles`` (no
    per-group value map merged in one task) and joined to the other aggregates
    on the group keys (NULL-safe)."""
    items = [list(i) for i in (spec.aggregations or [["*", "count", "count"]])]
    medians = [i for i in items if i[1] == "median"]
    if not medians:
        return df.groupBy(*[e.alias(n) for n, e in keys]).agg(*_aggs(spec, df))
    tmp = [f"_g{i}" for i in range(len(keys))]
    keyed = df.select("*", *[e.alias(t) for (_, e), t in zip(keys, tmp)])
    others = [i for i in items if i[1] != "median"]
    out = keyed.groupBy(*tmp).agg(*(_aggs(QuerySpec(aggregations=others), keyed) if others
                                     else [F.count(F.lit(1)).alias("_n")]))
    for item in medians:
        c = item[0]
        _check_cols(df, [c])
        name = item[2] if len(item) > 2 else f"median_{c}"
        med = (grouped_quantiles(keyed, tmp, col(c), [0.5], [name]).drop("n")
               .select(*[F.col(t).alias(t + "_m") for t in tmp], name))
        out = out.join(med, [F.col(t).eqNullSafe(F.col(t + "_m")) for t in tmp], "left") \
                 .drop(*[t + "_m" for t in tmp])
    names = [i[2] if len(i) > 2 else f"{i[1]}_{i[0]}" for i in items]
    return out.select(*[F.col(t).alias(n) for (n, _), t in zip(keys, tmp)], *[F.col(n) for n in names])


def _aggs(spec: QuerySpec, df: DataFrame) -> list[Column]:
    out = []
    for item in spec.aggregations or [["*", "count", "count"]]:
        c, fn = item[0], item[1]
        alias = item[2] if len(item) > 2 else f"{fn}_{c}"
        if fn not in AGGREGATES:
            raise QueryError(f"unknown aggregate {fn}")
        if c == "*":
            out.append(F.count(F.lit(1)).alias(alias))
            continue
        _check_cols(df, [c])
        out.append(AGGREGATES[fn](col(c)).alias(alias))
    return out


def run_query(df: DataFrame, spec: QuerySpec | dict | None, on_error: str = "raise") -> DataFrame:
    """Build the plan of ``spec`` over ``df``. ``on_error="input"`` returns the
    input unchanged on any error (the reference's behaviour); the default raises."""
    if spec is None:
        return df
    if isinstance(spec, dict):
        spec = QuerySpec(**spec)
    try:
        out = _build(df, spec)
        out.schema  # analysis errors surface here, before any job runs
        return out
    except Exception:
        if on_error == "input":
            return df
        raise


def _build(df: DataFrame, spec: QuerySpec) -> DataFrame:
    out = df
    if spec.sql:
        out = run_sql(out, spec.sql)
    if spec.filter:
        out = out.filter(F.expr(spec.filter))
    if spec.melt:
        m = spec.melt
        _check_cols(out, list(m.get("ids", [])) + list(m["values"]))
        # values of different kinds meet as text
        mixed = len({logical_types(out)[c] for c in m["values"]}) > 1
        values = [(col(c).cast("string") if mixed else col(c)).alias(c) for c in m["values"]]
        out = out.unpivot([col(c) for c in m.get("ids", [])], values,
                          m.get("var_name", "variable"), m.get("value_name", "value"))
    if spec.resample:
        r = spec.resample
        unit = r.get("unit", "month")
        if unit not in RESAMPLE_UNITS:
            raise QueryError(f"unknown resample unit {unit}")
        _check_cols(out, [r["time"]])
        keys = [(r["time"], F.date_trunc(unit, col(r["time"])))] + [(g, col(g)) for g in (spec.group_by or [])]
        grouped = _grouped(out, keys, spec)
        out = grouped if spec.group_by else _with_empty_periods(grouped, r["time"], unit, spec)
    elif spec.pivot:
        p = spec.pivot
        _check_cols(out, [p["column"]] + list(spec.group_by or []))
        items = spec.aggregations or [["*", "count", "count"]]
        if any(i[1] == "median" for i in items):
            # exact distributed aggregation per (groups, pivot value) first, then a
            # pivot of that small result (one row per cell)
            cells = _grouped(out, [(c, col(c)) for c in list(spec.group_by or []) + [p["column"]]], spec)
            names = [i[2] if len(i) > 2 else f"{i[1]}_{i[0]}" for i in items]
            values = _pivot_values(cells, p)
            g = cells.groupBy(*[col(c) for c in spec.group_by or []]).pivot(p["column"], values)
            out = g.agg(*[F.first(n).alias(n) for n in names])
        else:
            g = out.groupBy(*[col(c) for c in spec.group_by or []]).pivot(p["column"], _pivot_values(out, p))
            out = g.agg(*_aggs(spec, out))
    elif spec.group_by is not None or spec.aggregations:
        _check_cols(out, list(spec.group_by or []))
        out = _grouped(out, [(c, col(c)) for c in spec.group_by or []], spec)
    if spec.select:
        out = out.select(*[col(c) if c in out.columns else F.expr(c) for c in spec.select])
    if spec.order_by:
        keys = []
        for item in spec.order_by:
            name, direction = (item, "asc") if isinstance(item, str) else (item[0], item[1])
            c = col(name) if name in out.columns else F.expr(name)
            keys.append(c.desc() if direction == "desc" else c.asc())
        out = out.orderBy(*keys)
    if spec.limit is not None:
        out = out.limit(int(spec.limit))
    return out


PIVOT_COLUMNS = 10_000


def _pivot_values(df: DataFrame, p: dict) -> list:
    """The pivot's columns: as given, or every value found (each is a column of the
    result). The values are counted by a distributed aggregate first; more than
    PIVOT_COLUMNS (``max_columns`` of the spec) are an error that says how many there
    are, and no more than that many ever reach the driver."""
    if p.get("values") is not None:
        return list(p["values"])
    c, most = col(p["column"]), int(p.get("max_columns", PIVOT_COLUMNS))
    found = df.select(c).where(c.isNotNull()).distinct()
    n = found.count()
    if n > most:
        raise QueryError(f"pivot column {p['column']} has {n} values, more than {most}: "
                         "name the wanted ones or raise max_columns")
    return [r[0] for r in found.orderBy(c).collect()]


def _with_empty_periods(grouped: DataFrame, time: str, unit: str, spec: QuerySpec) -> DataFrame:
    """Periods between the first and the last without rows: counts and sums are 0
    there, other aggregates NULL."""
    grouped = grouped.where(col(time).isNotNull())
    step = F.expr("INTERVAL 3 MONTH" if unit == "quarter" else f"INTERVAL 1 {unit.upper()}")
    spine = grouped.agg(F.min(col(time)).alias("a"), F.max(col(time)).alias("b")) \
        .where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", step)).alias("_period"))
    full = spine.join(grouped, F.col("_period") == col(time), "left")
    zero = {i[2] if len(i) > 2 else ("count" if i[0] == "*" and len(i) < 2 else f"{i[1]}_{i[0]}")
            for i in (spec.aggregations or [["*", "count", "count"]]) if i[1] in ("sum", "count", "nunique")}
    return full.select(*[F.col("_period").alias(c) if c == time else
                         F.coalesce(col(c), F.lit(0).cast(t)).alias(c) if c in zero else col(c)
                         for c, t in grouped.dtypes])


def run_sql(df: DataFrame, text: str) -> DataFrame:
    """Q7: a SELECT over the table, written with ``{df}`` as the table name.

    Wrapping the text as a subquery makes anything but a query (DDL/DML,
    several statements) a parse error."""
    return df.sparkSession.sql("SELECT * FROM (\n" + text + "\n)", df=df)


# Q8 ---------------------------------------------------------------------------
def suggested_questions(target: str) -> list[str]:
    return [f"Show distribution of {target}.", f"How does {target} vary across different groups?"]


def suggested_groups(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Q8 "target across groups": for each categorical column (or each of
    ``columns``), (group_column, group_value, n, mean_target) for a numeric target or
    (group_column, group_value, target_value, n) counts."""
    df = normalize_missing(df)
    kinds = logical_types(df)
    groups = [c for c in (df.columns if columns is None else columns)
              if c != target and (columns is not None or kinds[c] == CATEGORICAL)]
    numeric = kinds[target] == NUMERIC
    if not groups:
        return df.sparkSession.createDataFrame(
            [], "group_column string, group_value string, n bigint, mean_target double")
    # one pass: explode each row into one (group column, value) entry per group column
    long = df.select(col(target).alias("_t"), F.inline(F.array(*[
        F.struct(F.lit(g).alias("group_column"), col(g).cast("string").alias("group_value"))
        for g in groups])))
    if numeric:
        return long.groupBy("group_column", "group_value").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("_t").cast("double")).alias("mean_target"))
    return long.groupBy("group_column", "group_value", F.col("_t").cast("string").alias("target_value")).agg(
        F.count(F.lit(1)).alias("n"))


# Q9 ---------------------------------------------------------------------------
@dataclass
class QueryLog:
    """Question log and pinned answers; a small driver-side list of entries."""
    entries: list[tuple] = field(default_factory=list)

    def log(self, question: str, spec: QuerySpec, response: str, pinned: bool = False,
            at: _dt.datetime | None = None) -> None:
        self.entries.append(((at or _dt.datetime.now()).replace(microsecond=0), question,
                             spec.to_json(), response, pinned))

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.entries, "timestamp timestamp, question string, spec string, response string, pinned boolean")

    def write(self, spark, path: str) -> None:
        self.to_frame(spark).write.mode("append").parquet(path)
