"""CSV ingest (S1, S2): delimiter detection and text type inference.

The delimiter is chosen from a small head of the file (the first 2,048
characters, read by Spark as text). Type inference follows the reading rules
of the reference: NA tokens become NULL; a column is integer if every non-null
value parses as an integer (integers with NULLs become double), else double,
else boolean (only without NULLs), else text; an all-NULL column is double;
dates stay text (the cleaning step detects them). It is one aggregate over
all columns, then one projection with casts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import agg_row
from ..functions.types import col
from .quoted import read_quoted

# Candidate delimiters in preference order, NA tokens, sniff size.
DELIMITERS = (",", ";", "\t", "|", " ")
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SNIFF_CHARS = 2048
INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
EXTRA = "__tabsense_extra"
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")


def sniff_delimiter(sample: str) -> str:
    """The delimiter that splits every complete sample line (outside quotes) into
    the same number (> 1) of fields; ',' when none does."""
    lines = [ln for ln in sample.splitlines()[:-1] or sample.splitlines() if ln.strip()]
    if not lines:
        return ","
    for d in DELIMITERS:
        counts = {_count_outside_quotes(ln, d) for ln in lines}
        if len(counts) == 1 and next(iter(counts)) > 0:
            return d
    return ","


def _count_outside_quotes(line: str, d: str) -> int:
    n, quoted = 0, False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        elif ch == d and not quoted:
            n += 1
    return n


def read_head(spark: SparkSession, path: str, chars: int = SNIFF_CHARS) -> str:
    """First ``chars`` characters of the file (every line has one with its end, so as
    many lines are enough)."""
    rows = spark.read.text(path).limit(chars).collect()
    return "\n".join(r[0] for r in rows)[:chars]


def _line_facts(spark: SparkSession, path: str, sep: str) -> dict:
    """One pass over the lines: whether a quoted field runs over a line end, and the
    smallest and largest number of delimiters outside quotes."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    hits = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
    r = spark.read.text(path).where(F.trim("value") != "").agg(
        F.coalesce(F.max((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2),
                   F.lit(0)).alias("odd"), F.min(hits).alias("least"), F.max(hits).alias("most")).first()
    return r.asDict()


def infer_types(df: DataFrame, na_tokens=NA_TOKENS) -> DataFrame:
    """S2 over all-text columns: NA tokens -> NULL, then the narrowest type of
    int (bigint), double, boolean, text that every non-null value fits."""
    cleaned = df.select(*[F.when(col(c).isin(list(na_tokens)), F.lit(None)).otherwise(col(c)).alias(c)
                          for c in df.columns])
    stats = agg_row(cleaned, [x for i, c in enumerate(cleaned.columns) for x in (
        F.count(col(c)).alias(f"n{i}"),
        F.count_if(col(c).rlike(INT_PATTERN) & col(c).try_cast("bigint").isNotNull()).alias(f"i{i}"),
        F.count_if(col(c).rlike(FLOAT_PATTERN) & col(c).try_cast("double").isNotNull()).alias(f"d{i}"),
        F.count_if(col(c).isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}"),
        F.count(F.lit(1)).alias(f"r{i}"))])
    out = []
    for i, c in enumerate(cleaned.columns):
        n, rows = stats[f"n{i}"], stats[f"r{i}"]
        x = col(c)
        if n == 0:
            out.append(x.cast("double").alias(c))
        elif stats[f"i{i}"] == n:
            out.append(x.try_cast("bigint" if n == rows else "double").alias(c))
        elif stats[f"d{i}"] == n:
            out.append(x.try_cast("double").alias(c))
        elif stats[f"b{i}"] == n and n == rows:
            out.append(x.isin(*TRUE_TOKENS).alias(c))
        else:
            out.append(x.alias(c))
    return cleaned.select(*out)


def inferred_types(df: DataFrame) -> DataFrame:
    """(column, type) of ``infer_types`` as a lazy frame (for checks)."""
    typed = infer_types(df)
    rows = [(c, t) for c, t in typed.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def read_csv_auto(spark: SparkSession, path: str, delimiter: str | None = None,
                  infer: bool = True) -> DataFrame:
    """Detect the delimiter, read with a header as UTF-8 text (bad bytes become
    U+FFFD), then infer types.

    One pass over the whole file checks what the head suggested: a delimiter that
    some line does not have where others have it is an error only if no line fits;
    where a line has an odd number of quotes, records are cut by ``quoted``, which
    reads ranges of a file in parallel all the same. Short rows are filled with NULL;
    rows with more fields than the header raise, as their number and values would
    otherwise be lost."""
    sep = delimiter or sniff_delimiter(read_head(spark, path))
    facts = _line_facts(spark, path, sep)
    options = {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": ""}
    reader = spark.read.options(**options).option("header", True).option("sep", sep) \
        .option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    # the header's own names; it may hold a line end itself
    names = reader.option("multiLine", bool(facts["odd"])).csv(path).columns
    if facts["odd"]:
        raw = read_quoted(spark, path, sep, len(names) + 1, options).toDF(*names, EXTRA)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, EXTRA]])
        raw = reader.option("multiLine", False).schema(schema).csv(path)
    # without an odd quote, no row can have more fields than a line has delimiters
    if facts["odd"] or (facts["most"] or 0) >= len(names):
        long_rows = raw.where(col(EXTRA).isNotNull()).count()
        if long_rows:
            raise ValueError(f"{long_rows} rows of {path} have more than {len(names)} fields")
    raw = raw.drop(EXTRA)
    return infer_types(raw) if infer else raw
