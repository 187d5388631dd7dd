"""How far the sources of a language lie apart in their words.

Texts are counted by task into (lang, source, term) sums, so a hot source is added up
before it is shuffled. The sums of a language are dealt to buckets of terms, by hash and as
columns; a bucket adds them up and keeps the terms of enough documents. Kept
terms are dealt to slices by their hash, and numbered within a slice; a group
(lang, source) becomes one sorted array of (term id, count) per slice, of bounded
length. For each unordered pair of a language's groups, and each slice, a task gets
both arrays and merges them: a galloping search finds the terms that both have; these,
the terms that one has, and those that neither has are priced by themselves. The price
is the same both ways, so a pair is merged once and reported for both of its groups.

All arithmetic is exact: 64-bit integers below 2**53 tokens a language (long division in
base 1,000), decimals of 38 digits where Spark computes.

Memory per task: the terms met so far (at most ``HELD``), one bucket's sums (their
number grows with the text), or two arrays of one slice.
The result has a row per ordered pair of sources, as asked; a pair's terms never leave
its tasks.

Defined cases: null text, lang and source are ''; a text without terms still counts as
a document and makes its group occur; repeated rows are documents of their own; a
language without kept terms has values of 0 and no ``term`` rows; a language of one
source has no ``pair`` rows; an empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, releasing
from .exchange import pack_keys, pack_values, unpack_keys, unpack_values

LEAST_DOCS = 10      # documents of a language that must hold a kept term
TOP = 10             # ranks of part ``term``
SCALE = 1_000_000_000
SLICE_TERMS = 50_000
HELD = 400_000       # (group, term) sums that a task holds before it sends them
BUCKET_BYTES = 32 << 20  # bytes of text for which there is one bucket of terms
SUMS = ["source", "term", "n", "docs"]
CHUNK = 256          # sought ids between two gallops
#: bytes of a text -> letters in lower case, everything that is in no term -> space
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                for b in range(256))


# ---- counts --------------------------------------------------------------

def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of all signs beyond ASCII; only A-Z are lower-cased."""
    return text.translate(LETTERS).split()


class Sums:
    """Occurrences and documents of each term of each group."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        n, docs = self.held.setdefault(group, (Counter(), Counter()))
        before = len(n)
        found = terms(text)
        n.update(found)
        docs.update(set(found))
        self.size += len(n) - before

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """One row per language and bucket: its sums, by source and term."""
        parts: dict[tuple[str, int], list[pa.RecordBatch]] = {}
        for (lang, source), (n, docs) in self.held.items():
            bucket = np.fromiter(map(crc32, n), np.int64, len(n)) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            sums = pa.record_batch([
                pa.repeat(source, len(n)), pa.array(list(n), pa.binary()).cast(pa.string()),
                pa.array(list(n.values()), pa.int64()),
                pa.array([*map(docs.__getitem__, n)], pa.int64())], SUMS).take(pa.array(order))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                parts.setdefault((lang, k), []).append(sums.slice(edges[k], edges[k + 1] - edges[k]))
        for (lang, k), found in parts.items():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, found[0].schema) as out:
                out.write_table(pa.Table.from_batches(found).combine_chunks())
            yield pa.record_batch([pa.array([lang]), pa.array([k], pa.int32()),
                                   pa.array([sink.getvalue().to_pybytes()])], ["lang", "bucket", "sums"])
        self.held, self.size = {}, 0


def added(sums: pa.Table, least_docs: int) -> pa.Table:
    """source, term, n, lang_n and first (true once a term) of the terms that enough
    documents hold, from all sums of a bucket of a language."""
    codes = pc.dictionary_encode(sums["term"].combine_chunks())
    code = codes.indices.to_numpy()
    size = len(codes.dictionary)
    docs, lang_n = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(docs, code, sums["docs"].to_numpy())
    np.add.at(lang_n, code, sums["n"].to_numpy())
    kept = docs[code] >= least_docs
    by = pa.table({"source": sums["source"].filter(kept), "code": code[kept],
                   "n": sums["n"].filter(kept)}) \
        .group_by(["code", "source"]).aggregate([("n", "sum")]).sort_by("code")
    code = by["code"].to_numpy()
    return pa.table({"source": by["source"], "term": codes.dictionary.take(pa.array(code)),
                     "n": by["n_sum"], "lang_n": lang_n[code],
                     "first": np.diff(code, prepend=-1) != 0})


def kept_counts(docs: DataFrame, least_docs: int, buckets: int) -> DataFrame:
    """lang, source, term, n (occurrences), lang_n (in the language) and first (true
    once per lang and term) of the terms that at least so many documents hold. A task
    sends its sums by buckets of terms, so a bucket has all there is of its terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            texts = b[2].cast(pa.binary())
            for lang, source, text in zip(b[0].to_pylist(), b[1].to_pylist(), texts, strict=True):
                sums.add((lang, source), text.as_py())
                if sums.size >= HELD:
                    yield from sums.rows(buckets)
        yield from sums.rows(buckets)

    def add(rows: pa.Table) -> pa.Table:
        found = added(pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all()
                                        for x in rows["sums"]]), least_docs)
        return found.add_column(0, "lang", pa.repeat(rows["lang"][0], found.num_rows))

    return docs.select("lang", "source", "text") \
        .mapInArrow(releasing(run), "lang string, bucket int, sums binary") \
        .groupBy("lang", "bucket").applyInArrow(
            add, "lang string, source string, term string, n long, lang_n long, first boolean")


# ---- exact prices --------------------------------------------------------

def shares(count: np.ndarray | int, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), by long division in base
    1,000: no step exceeds 64 bits while the divisor is below 2**53."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, np.int64(total + 2 * kept))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.int64(total + 2 * kept))
        whole = whole * 1000 + digit
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places in ``many`` at which the ids ``few`` are or would be (both sorted). From
    the place of the last id found, the step doubles until it passes the next ``CHUNK``
    ids, which are then sought between; parts of ``many`` that are stepped over are
    never read."""
    out = np.empty(len(few), np.int64)
    low = 0
    for at in range(0, len(few), CHUNK):
        some = few[at:at + CHUNK]
        step = CHUNK
        while low + step < len(many) and many[low + step] < some[-1]:
            step *= 2
        high = min(low + step + 1, len(many))
        out[at:at + CHUNK] = low + np.searchsorted(many[low:high], some)
        low = int(out[min(at + CHUNK, len(few)) - 1])
    return out


def merge(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray,
          total_a: int, total_b: int, kept: int, terms_here: int) -> int:
    """Sum of the prices of ``terms_here`` terms, of which two groups have these. ``kept``
    terms and ``total_a``, ``total_b`` occurrences are those of all slices."""
    if len(ids_a) > len(ids_b):
        ids_a, n_a, total_a, ids_b, n_b, total_b = ids_b, n_b, total_b, ids_a, n_a, total_a
    place = gallop(ids_a, ids_b)
    inside = place < len(ids_b)
    both = np.zeros(len(ids_a), bool)
    both[inside] = ids_b[place[inside]] == ids_a[inside]
    only_b = np.ones(len(ids_b), bool)
    only_b[place[both]] = False
    p, q = shares(n_a, total_a, kept), shares(n_b, total_b, kept)
    p_none, q_none = shares(0, total_a, kept), shares(0, total_b, kept)
    absent = terms_here - len(ids_a) - len(ids_b) + int(both.sum())
    return int(price(p[both], q[place[both]]).sum() + price(p[~both], q_none).sum()
               + price(p_none, q[only_b]).sum() + absent * price(p_none, q_none))


def _share(count: Column, total: Column, kept: Column) -> Column:
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", wide, (total + 2 * kept).cast("decimal(20,0)")) + 1


# ---- Spark ---------------------------------------------------------------

def _arrays(rows: DataFrame) -> DataFrame:
    """One row per group and slice: its sorted ids and their counts, compressed."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        first = rows.iloc[0]
        return pd.DataFrame([(first["lang"], first["source"], first["slice"],
                              pack_keys(rows["id"].to_numpy(np.uint64)),
                              pack_values(rows[["n"]].to_numpy(np.int64)))],
                            columns=["lang", "source", "slice", "ids", "counts"])

    return rows.select("lang", "source", "slice", "id", "n").groupBy("lang", "source", "slice") \
        .applyInPandas(run, "lang string, source string, slice int, ids binary, counts binary")


def _pair_values(groups: DataFrame, arrays: DataFrame, slices: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b) and value of every unordered pair of groups."""
    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"))

    pairs = side("a").join(side("b"), "lang").filter("a < b")
    # a pair task per slice: the co-groups of the pair's two sides
    tasks = pairs.join(slices, "lang")
    left = tasks.join(arrays.withColumnsRenamed({"source": "a"}), ["lang", "a", "slice"], "left")
    right = pairs.select("lang", "a", "b").join(arrays.withColumnsRenamed({"source": "b"}), ["lang", "b"])
    # columns of the sides' own: both come from the same tables
    left, right = (x.select(*[F.col(c).alias(f"{c}_{name}") for c in x.columns])
                   for x, name in ((left, "x"), (right, "y")))
    of = ["lang", "a", "b", "slice"]

    def unpacked(rows: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows) or rows[f"ids_{name}"].iloc[0] is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return unpack_keys(rows[f"ids_{name}"].iloc[0]), \
            unpack_values(rows[f"counts_{name}"].iloc[0], 1)[:, 0]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        task = x.iloc[0]
        value = merge(*unpacked(x, "x"), *unpacked(y, "y"),
                      *[int(task[f"{c}_x"]) for c in ("total_a", "total_b", "kept", "terms_here")])
        return pd.DataFrame([(task["lang_x"], task["a_x"], task["b_x"], value)],
                            columns=["lang", "a", "b", "value"])

    merged = left.groupBy(*[f"{c}_x" for c in of]).cogroup(right.groupBy(*[f"{c}_y" for c in of])) \
        .applyInPandas(run, "lang string, a string, b string, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return pairs.select("lang", "a", "b").join(merged, ["lang", "a", "b"], "left") \
        .withColumn("value", F.coalesce("value", F.lit(0)))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP,
               slice_terms: int = SLICE_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])
    found = cut_lineage(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size")))
    size = found.agg(F.sum("size")).first()[0] or 0
    met = cut_lineage(kept_counts(docs, least_docs, -(-size // BUCKET_BYTES) or 1))
    kept = met.filter("first").select("lang", "term", "lang_n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    most = langs.agg(F.max("kept")).first()[0] or 0
    n_slices = -(-most // slice_terms) or 1
    in_slice = Window.partitionBy("lang", "slice").orderBy("term")
    numbered = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int")) \
        .withColumn("id", F.row_number().over(in_slice) - 1)
    slices = numbered.groupBy("lang", "slice").agg(F.count("*").alias("terms_here"))
    slices = cut_lineage(slices.join(langs.select("lang", "kept"), "lang"))
    held = cut_lineage(met.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(found.select("lang", "source")
                         .join(totals, ["lang", "source"], "left")
                         .withColumn("total", F.coalesce("total", F.lit(0))))

    pairs = _pair_values(groups, cut_lineage(_arrays(held)), slices)
    ways = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way"), "value") \
        .select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = _share(F.col("n"), F.col("total"), F.col("kept")), \
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    over = held.join(groups, ["lang", "source"]).join(langs, "lang").filter("n > 0") \
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")),
                            F.col("p") + F.col("q"))
    best = over.select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value")) \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ways.withColumn("rank", F.row_number().over(order)).unionByName(best)
