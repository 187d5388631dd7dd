"""URL filters: path rules first, then trust and distrust propagated over links.

A rule allows or blocks a host with its subdomains below a path; the longest
fitting rule decides. Pages without a rule are judged by their host: trust
spreads from hosts in proportion to their allowed pages along links between
hosts, distrust from hosts in proportion to their blocked pages against them
(a host that links to blocked ones is suspect). Both are personalised PageRanks;
a host is blocked where distrust exceeds ``threshold`` times trust. A host that
neither reaches is allowed. Seeds are counts of pages and ranks are linear in them, so
pages and hosts elsewhere change no verdict. Ranks only grow from step to step; steps
end when no host is newly reached and no rank grows by more than a share ``tolerance``
of itself, however large the table or small the seed.

All of it is DataFrame expressions. Links are counted per pair of hosts before
they are joined, so steps run on hosts, not pages. A host's hot in- or out-edges
only meet as partial sums; the pages of a hot host are joined with its verdict
in salted parts.

Defined cases: a null url or one without ``://`` has an empty host and path and
is allowed; null html has no links; repeated rows count as often as they occur;
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
DAMPING, TOLERANCE, SALTS = 0.85, 1e-6, 32


class Rule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"),
         Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"),
         Rule("net", "/fr/", "block")]


def _rest(url: Column) -> Column:
    """What follows the first ``://`` (empty where there is none)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    df = df.withColumn("_rest", _rest(F.coalesce(F.col(url).cast("string"), F.lit(""))))
    df = df.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    return df.withColumn("path", F.regexp_extract(
        F.substr(F.col("_rest"), F.length("_host") + 1), r"^[^?#]*", 0)) \
        .withColumn("host", F.translate("_host", UPPER, LOWER)).drop("_rest", "_host")


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` and ``action`` of the longest rule that fits (else null)."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) \
            & F.col("path").startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return df.withColumn("rule", name).withColumn("action", action)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the absolute links of html."""
    found = with_host(pages.select("url", "html")).select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
        .alias("link"))
    absolute = found.select("src", F.when(F.col("link").startswith("//"),
                                          F.concat(F.lit(":"), F.col("link")))
                            .otherwise(F.col("link")).alias("link"))
    return with_host(absolute, "link").select("src", F.col("host").alias("dst")) \
        .filter("src <> '' and dst <> '' and src <> dst") \
        .groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING,
           tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (host, kind, rank) of seeds (host, kind, seed): kind
    ``trust`` follows links, ``distrust`` goes against them."""
    edges = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"),
                         F.col("dst").alias("to"), "links").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"),
                     F.col("src").alias("to"), "links"))
    out = edges.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    edges = cut_lineage(edges.join(out, ["kind", "host"])
                        .select("kind", "host", "to", (F.col("links") / F.col("all")).alias("w")))
    start = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("rank"))
    rank = cut_lineage(start)
    if edges.isEmpty():
        return rank
    grown = 1.0
    while grown >= tolerance:
        flow = rank.join(edges, ["kind", "host"]).select(
            F.col("to").alias("host"), "kind", (F.col("rank") * F.col("w") * damping).alias("rank"))
        after = cut_lineage(start.unionByName(flow).groupBy("host", "kind")
                            .agg(F.sum("rank").alias("rank")))
        share = 1 - F.coalesce(F.col("before"), F.lit(0.0)) / F.col("rank")
        grown = after.join(rank.withColumnRenamed("rank", "before"), ["host", "kind"], "left") \
            .filter("rank > 0").agg(F.max(share)).first()[0] or 0.0
        rank = after
    return rank


def judge(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row."""
    rows = with_rule(with_host(pages.select(F.col("page_id"), "url")), rules) \
        .select("page_id", "host", "path", "rule", "action")
    seeds = rows.filter("host <> '' and action is not null").groupBy("host", "action") \
        .agg(F.count("*").alias("n"))
    seeds = seeds.select("host", F.when(F.col("action") == "allow", "trust").otherwise("distrust")
                         .alias("kind"), F.col("n").cast("double").alias("seed"))
    rank = spread(host_links(pages), seeds)
    hosts = rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    zero = F.lit(0.0)
    return own.join(salted, ["host", "salt"], "left") \
        .withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)}) \
        .select("page_id", "host", "path", "rule",
                F.coalesce("action", F.when(F.col("distrust") > F.col("trust") * threshold, "block")
                           .otherwise("allow")).alias("verdict"), "trust", "distrust")
