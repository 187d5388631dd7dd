"""Near-duplicates by MinHash, banding and connected components.

Documents with the same set of shingles form a class; one of each goes on. A
class has 160 universal hash minima in 32 bands of five; pairs of sets with a
Jaccard coefficient of 0.8 share a band with probability 1 - 3e-6. Within a band's
bucket all pairs are never listed: every class is compared with the bucket's
smallest one. A comparison first checks the signatures (a byte of each minimum; five
standard deviations below the threshold are rejected), then the full sets. Buckets whose classes are
then in one component are done. In the others, the classes outside a bucket's largest
component (strays) meet all its classes in blocks: chunks of bounded bytes, each pair of
chunks in one task, where NumPy compares a stray's signature and then its full set
with a whole chunk; only links leave the block, never pairs. So no link inside a
bucket is lost. Blocks begin once the pairs to compare are at most 1,000 per class (four
times as many after each round that finds nothing); before that, strays meet four
more members of the bucket's largest component in each round.

Defined cases: a null text, or one without words, has an empty set and is linked
with nothing; rows with a null id are linked with nothing and kept; rows with
equal ids are one document as to links; an empty table gives an empty result;
other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, parts_for, releasing, text_or_empty
from .components import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
PAIRS = 20_000  # pairs whose full sets one task compares at least
OUTRIGHT = 1_000  # pairs per class that are compared in blocks at once
CHUNK = 4 << 20   # bytes of signatures and sets on either side of a block
CENTRES = 4     # members of a bucket's largest component that meet the others in a round
ENDS = 1_000_000  # nodes (8 bytes each) that are broadcast
BRIEF = 100_000   # nodes whose brief signatures (160 bytes each) are broadcast
CACHE = 500_000
_RNG = np.random.default_rng(20_240_229)
FACTOR = _RNG.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32)
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def shingles(text: bytes, size: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles (fewer words:
    of the whole sequence) of a text, A-Z lower-cased."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.array([words[w] for w in split], np.uint64)
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = _mix(total * PLACE[k] + h[k:len(h) - n + 1 + k])
    return np.unique(total)


def signature(sets: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes x -> a x + b mod 2**32 of the folded shingles."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    folded = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 512):  # a block stays in the processor's cache
        part = folded[at:at + 512, None] * FACTOR
        part += SHIFT
        np.minimum(low, part.min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k, column in enumerate(sig.reshape(BANDS, ROWS).T.astype(np.uint64)):
            total = _mix(total * PLACE[k] + column)
    return total.view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty) and sig per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            counts, keys, sigs = [], [], []
            for text in b[1].cast(pa.binary()).to_pylist():
                s = shingles(text, size, words)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([b[0], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                                   pa.array(sigs, pa.binary())],
                                  ["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
        .mapInArrow(releasing(run), "doc_id long, n_shingles long, key binary, sig binary")


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, node, n): one row per class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.concatenate([band_keys(np.frombuffer(s, np.uint32))
                                       for s in b[2].to_pylist()])
                node, n = (np.repeat(c.to_numpy(), BANDS) for c in b.columns[:2])
                yield pa.record_batch([pa.array(keys), pa.array(node), pa.array(n)],
                                      ["bucket", "node", "n"])

    return classes.select("node", "n", "sig").mapInArrow(run, "bucket long, node long, n long")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def few_of(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The rows of the given ``n`` nodes. Up to ``ENDS`` nodes are broadcast, so that
    signatures and texts of others are never shuffled."""
    return rows.join(F.broadcast(nodes) if n <= ENDS else nodes, "node", "left_semi")


def least_agreement(percent: int) -> float:
    """How many of the minima's low bytes agree at least: five standard deviations below
    what the threshold expects. Different minima share a byte with probability 1/256."""
    t = percent / 100
    t += (1 - t) / 256
    return HASHES * (t - 5 * (t * (1 - t) / HASHES) ** 0.5)


def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a signature, becomes the low byte of each minimum."""
    for b in batches:
        low = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in b[-1].to_pylist()]
        yield pa.record_batch([*b.columns[:-1], pa.array(low, pa.binary())], [*b.schema.names[:-1], "low"])


class Block:
    """Strays against the classes of one chunk of their bucket."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        self.percent, self.least = percent, least_agreement(percent)
        self.node, self.component = (rows[c].to_numpy() for c in ("node", "component"))
        self.top, stray = (rows[c].to_numpy() for c in ("top", "stray"))
        self.strays, self.others = np.flatnonzero(stray), np.flatnonzero(~stray)
        self.low = np.frombuffer(b"".join(rows["low"].to_pylist()), np.uint8).reshape(-1, HASHES)
        self.sets = [np.frombuffer(x, np.uint64) for x in rows["s"].to_pylist()]
        self.n = np.array([len(x) for x in self.sets], np.int64)

    def shared(self, at: int, with_: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set ``at`` with those of ``with_`` (places in others)."""
        mine = self.sets[at]
        place = np.minimum(np.searchsorted(self.words, mine), len(self.words) - 1)
        mark = np.zeros(len(self.words), np.uint8)
        mark[place[self.words[place] == mine]] = 1
        if len(with_) * 3000 > len(self.ids):
            return np.add.reduceat(mark[self.ids], self.starts[:-1], dtype=np.int64)[with_]
        return np.array([mark[self.ids[self.starts[k]:self.starts[k + 1]]].sum(dtype=np.int64)
                         for k in with_], np.int64)

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that join components, one for each two that are not joined yet."""
        if not len(self.strays) or not len(self.others):
            return
        self.words, self.ids = np.unique(np.concatenate([self.sets[k] for k in self.others]),
                                         return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.n[self.others])])
        label = np.unique(self.component, return_inverse=True)[1]
        low, n, top, component = (x[self.others] for x in (self.low, self.n, self.top, self.component))
        for at in self.strays:
            mine = self.n[at]
            # two strays meet once, by the order of their components
            fits = (label[self.others] != label[at]) & (top | (component > self.component[at])) \
                & (np.minimum(n, mine) * 100 >= np.maximum(n, mine) * self.percent)
            near = np.flatnonzero(fits)
            near = near[(low[near] == self.low[at]).sum(axis=1) >= self.least]
            if not len(near):
                continue
            both = self.shared(at, near)
            for k in self.others[near[100 * both >= self.percent * (mine + n[near] - both)]]:
                if label[k] != label[at]:
                    label[label == label[k]] = label[at]
                    yield self.node[at], self.node[k]


class Verifier:
    """Links among pairs of classes, by signatures and then by full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> None:
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent

    def by_signature(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures agree enough."""
        least = least_agreement(self.percent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES)
                        for c in b.columns[2:])
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.record_batch([c.filter(keep) for c in b.columns[:2]], ["u", "v"])

        nodes = cut_lineage(ends_of(pairs))
        n = nodes.count()
        low = few_of(self.classes.select("node", "sig"), nodes, n) \
            .mapInArrow(brief, "node long, low binary")
        if n <= BRIEF:
            low = F.broadcast(low)
        both = pairs.join(low.withColumnsRenamed({"node": "u", "low": "x"}), "u") \
            .join(low.withColumnsRenamed({"node": "v", "low": "y"}), "v")
        return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, key, s): the full sets of the given classes; of rows with one id but
        different texts, each set."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()
            for b in batches:
                found = [shingles(t, size, words).tobytes()
                         for t in b[1].cast(pa.binary()).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s) for s in found]
                yield pa.record_batch([b[0], pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
                                      ["node", "key", "s"])

        rows = self.docs.select(F.col("doc_id").cast("long").alias("node"),
                                text_or_empty().alias("text"))
        nodes = cut_lineage(nodes)
        return few_of(rows, nodes, nodes.count()).mapInArrow(releasing(run), "node long, key binary, s binary") \
            .dropDuplicates(["node", "key"])

    def block_links(self, apart: DataFrame, mixed: DataFrame) -> DataFrame:
        """(u, v): links across the components of the mixed buckets, as many as it takes
        to join what is linked. Rows are dealt to chunks by their hash; each chunk
        of strays meets each chunk of its bucket."""
        percent = self.percent
        key = ["bucket", "i", "j"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                if held and (pairs := list(Block(pa.Table.from_batches(held), percent).links())):
                    u, v = zip(*pairs, strict=True)
                    yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

            held, last = [], None
            for b in batches:
                if not b.num_rows:
                    continue
                place = np.stack([c.to_numpy() for c in b.columns[:3]])
                cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
                for start, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                    if last != (now := tuple(place[:, start])):
                        yield from compared(held)
                        held, last = [], now
                    held.append(b.slice(start, end - start))
            yield from compared(held)

        rows = apart.select("bucket", "node", "component").join(mixed, "bucket") \
            .withColumn("top", F.col("component") == F.col("of"))
        chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        mine = ["node", "component", "top"]
        strays = rows.filter("not top").select("bucket", chunk("stray_chunks").alias("i"),
                                               each("chunks").alias("j"), *mine, F.lit(True).alias("stray"))
        others = rows.select("bucket", each("stray_chunks").alias("i"), chunk("chunks").alias("j"),
                             *mine, F.lit(False).alias("stray"))
        nodes = cut_lineage(rows.select("node").distinct())
        low = few_of(self.classes.select("node", "key", "sig"), nodes, nodes.count()) \
            .mapInArrow(brief, "node long, key binary, low binary")
        known = cut_lineage(low.join(self.sets(nodes), ["node", "key"]).drop("key"))
        return strays.unionByName(others).join(known, "node") \
            .select(*key, *mine, "stray", "low", "s") \
            .repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sets are alike."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.record_batch([c.filter(keep) for c in b.columns[:2]], ["u", "v"])

        parts = parts_for(pairs.count(), PAIRS)
        likely = cut_lineage(self.by_signature(pairs).coalesce(parts))
        sets = cut_lineage(self.sets(ends_of(likely)).drop("key"))
        both = likely.join(sets.withColumnsRenamed({"node": "u", "s": "x"}), "u") \
            .join(sets.withColumnsRenamed({"node": "v", "s": "y"}), "v")
        return cut_lineage(both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")
                           .coalesce(parts))


def class_links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    rows = banded(classes)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("centre")) \
        .filter("c > 1").drop("c")
    rows = cut_lineage(rows.join(shared, "bucket"))
    size_of = classes.select(F.col("node").alias("centre"), F.col("n").alias("m"))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    check = Verifier(docs, classes, size, percent)
    first = rows.filter("node <> centre").select("centre", "node", "n").distinct()
    tried = cut_lineage(first.join(size_of, "centre").filter(fits)
                        .select(F.col("centre").alias("u"), F.col("node").alias("v")))
    links = check.links(tried)
    parts = parts_for(rows.count(), 1_000_000)
    allowed = OUTRIGHT * classes.count()
    found = cut_lineage(components(links).coalesce(parts))
    for turn in count():
        apart = rows.select("bucket", "node", "n").join(found, "node", "left") \
            .withColumn("component", F.coalesce("component", "node"))
        # buckets with several components, and how many pairs their strays would meet
        sizes = apart.groupBy("bucket", "component").agg(
            F.count("*").alias("c"), F.sum(8 * F.col("n") + HASHES + 64).alias("w"))
        chunks = lambda w: F.ceil(w / F.lit(CHUNK))
        mixed = cut_lineage(sizes.groupBy("bucket").agg(
            F.sum("c").alias("all"), F.sum("w").alias("w"), F.count("*").alias("k"),
            F.max(F.struct("c", "component", "w")).alias("most"))
            .filter("k > 1").select(
                "bucket", F.col("most.component").alias("of"), chunks(F.col("w")).alias("chunks"),
                chunks(F.col("w") - F.col("most.w")).alias("stray_chunks"),
                ((F.col("all") - F.col("most.c")) * F.col("all")).alias("pairs"))
            .coalesce(parts))
        across = mixed.agg(F.sum("pairs")).first()[0] or 0
        if not across:
            return found
        outright = across <= allowed
        if outright:
            more = cut_lineage(check.block_links(apart, mixed.drop("pairs")))
        else:  # some members of the largest component meet those of the others
            both = apart.join(mixed.select("bucket", "of"), "bucket")
            picks = [F.min(F.struct(F.xxhash64("node", F.lit(CENTRES * turn + k)), F.col("node"),
                                    F.col("n").alias("m"))).alias(f"pick{k}") for k in range(CENTRES)]
            firsts = F.array_distinct(F.array(*(F.struct(f"pick{k}.node", f"pick{k}.m")
                                                for k in range(CENTRES))))
            centres = both.filter("component = of").groupBy("bucket").agg(*picks) \
                .select("bucket", F.explode(firsts).alias("first"))
            pairs = both.filter("component <> of").select("bucket", "node", "n").join(centres, "bucket") \
                .select(F.col("first.node").alias("centre"), "node", "n", F.col("first.m").alias("m")) \
                .filter(fits).select(F.least("centre", "node").alias("u"),
                                     F.greatest("centre", "node").alias("v")).distinct()
            fresh = cut_lineage(pairs.join(tried, ["u", "v"], "left_anti").coalesce(parts))
            more = check.links(fresh)
            tried = tried.unionByName(fresh)
        if not more.isEmpty():
            found = cut_lineage(components(more.unionByName(
                found.select(F.col("node").alias("u"), F.col("component").alias("v")))).coalesce(parts))
        elif not outright:
            allowed *= 4  # the centres found nothing: allow more pairs in blocks
        if outright:
            return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = cut_lineage(signed(docs, size))
    ids = rows.filter("doc_id is not null and key is not null")
    classes = cut_lineage(ids.groupBy("key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    found = class_links(docs, classes, size, percent)
    of_class = cut_lineage(classes.select("key", "node").join(found, "node", "left").select(
        F.col("key").alias("class_key"), F.coalesce("component", "node").alias("component")))
    linked = rows.select("doc_id", "n_shingles", "key").join(
        of_class, (F.col("key") == F.col("class_key")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id (rows without
    id come last; among rows with one id, the smallest hash). Rows are told apart by
    id and text, not by id alone: of repeated rows, with or without id, one stays, and
    different texts under one id are documents of their own. Rows with an empty set
    are linked with nothing and all stay."""
    name = F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), text_or_empty())
    named = docs.withColumn("_name", name)
    rows = near_duplicates(named.select(F.col("_name").alias("doc_id"), "text"), size, percent)
    found = cut_lineage(rows.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_name")).agg(
        F.min("component_id").alias("component"), F.count("*").alias("copies")))
    many = found.groupBy("component").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut_lineage(found.join(many, "component").select("_name", "component"))
    first = named.select("_name", "doc_id").join(members, "_name").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "_name"))["_name"].alias("stays"))
    gone = members.join(first, "component").filter("_name <> stays").select("_name")
    again = found.filter("copies > 1").select("_name")
    left = named.join(gone, "_name", "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    # copies of a row collapse inside each task before they meet
    once = left.join(again, "_name", "left_anti").unionByName(
        left.join(again, "_name", "left_semi").dropDuplicates(["_name"]))
    return once.select(*docs.columns)
