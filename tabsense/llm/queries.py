"""Registered queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents, pages  # noqa: F401
from .bpe import round_trip
from .divergence import divergence
from .lm import score
from .minhash import near_duplicates
from .packing import pack
from .quality import quality
from .repair import repair_digest
from .spotsigs import with_edits
from .suffix import dedup
from .tokenfiles import token_files
from .toxicity import scored
from .urls import judge
from .warc import pages_to_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).drop("distance", "text_hash")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_warc(pages(spark, sf_dir)).drop("url")


@query
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept")


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(pages(spark, sf_dir)).drop("trust", "distrust")


@query
def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2, percent=80)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


ORACLE["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT d, lang, source,
         unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM full_counts GROUP BY ALL),
shares AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 2)) // (t.total + 2 * l.v) AS p,
         1 + (1000000000 * (f.lang_n + 2)) // (l.lang_total + 2 * l.v) AS q
  FROM full_counts f JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
no_terms AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM langs)),
items AS (
  SELECT * FROM pairs UNION ALL SELECT * FROM no_terms UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part
                               ORDER BY value DESC, encode(item))::INTEGER AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
