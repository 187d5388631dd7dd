"""Document fingerprints by spot signatures.

Wherever a common word (an anchor) stands, the chain of the next content words
after it makes a signature; a document's fingerprint is the set of its
signatures. Likeness is the Jaccard coefficient of two sets. Sets whose lengths
differ too much cannot be alike: the similarity join deals sets to partitions by
length, compares within a partition and its neighbour only, finds partners by the
rarest signatures of a set (any two sets that are alike share one of these), and
stops counting as soon as the coefficient cannot be reached any more.

Fingerprints are written as base64 of the sorted 32-bit signatures, so they can
be compared without the texts.

Defined cases: a null or empty text has the empty fingerprint, which is like
itself (1) and unlike any other (0); a text without an anchor lets chains start
at every word; rows with equal ids are ordered by their texts; rows with a null id
follow all others; an empty table gives an empty result; other columns are not
read.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, text_or_empty

CHAIN = 3
#: fixed values: common words of English, German, French and Spanish
ANCHORS = frozenset(
    b"the of and to in a is that it for on was with be as by this are at from "
    b"der die das und ist ein eine nicht mit von zu den dem des im auf "
    b"le la les de et un une est que qui dans pour pas au avec "
    b"el los las en y del por con para no se su una al como".split())
STRIP = b".,;:!?()[]{}\"'|*#$%&<>-_"


def signatures(text: bytes, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a UTF-8 text."""
    words, anchored = [], []
    for w in text.lower().split():
        w = w.strip(STRIP)
        if not w:
            continue
        if w in ANCHORS:
            anchored.append((w, len(words)))
        else:
            words.append(w)
    if not words:  # anchors alone: they are the content
        words, anchored = [w for w, _ in anchored], []
    if not anchored:
        anchored = [(b"", k) for k in range(max(0, len(words) - chain) + 1)] if words else []
    found = {xxhash.xxh32_intdigest(w + b" " + b" ".join(words[k:k + chain])) for w, k in anchored}
    return np.array(sorted(found), "<u4")


def write(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _need(n: int, m: int, threshold: float) -> int:
    """Fewest common signatures with which sets of n and m are alike."""
    return int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Pruned Jaccard over sorted sets: stops when too few signatures are left."""
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m) or not n:
        return False
    need, both = _need(n, m, threshold), 0
    for at in range(0, n, 64):
        part = a[at:at + 64]
        both += int(np.isin(part, b, assume_unique=True).sum())
        if both + n - at - len(part) < need:
            return False
    return both >= need


# ---- fingerprints of documents and of their edited texts -------------------

def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the head of the one that follows."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, " \
      "edited_fingerprint string, near_edited double, near_next double"


def in_order(docs: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Rows (part, doc_id, text, own) sorted within partitions by descending id;
    each part of the id range ends with the first row of the next part (own =
    false), the last with the first row of all. Only one number per part passes
    through the driver."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.filter("doc_id is not null").approxQuantile(
        "doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.array(sorted({min(int(c), 2 ** 63 - 1) for c in cuts}), np.int64)
    last = len(bounds)  # part 0 has the largest ids, part last + 1 the null ones

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b[0].is_null().to_numpy(zero_copy_only=False)
            values = b[0].fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(null, last + 1, last - np.searchsorted(bounds, values, "left"))
            yield pa.record_batch([pa.array(part, pa.int32()), *b.columns],
                                  ["part", *b.schema.names])

    first = ids.mapInArrow(deal, "part int, doc_id long").groupBy("part") \
        .agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()
    follows = {r["part"]: q for q, r in zip([x["part"] for x in first],
                                            [*first[1:], *first[:1]], strict=True)}
    # part -> its head's id; the head also goes to the part before
    heads = {r["part"]: r["doc_id"] for r in first}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in deal(batches):
            yield pa.record_batch([*b.columns, pa.array([True] * b.num_rows)],
                                  [*b.schema.names, "own"])
            part = b[0].to_pylist()
            head = [heads[p] == i for p, i in zip(part, b[1].to_pylist(), strict=True)]
            if any(head):
                extra = b.filter(pa.array(head))
                before = [follows[p] for p in extra[0].to_pylist()]
                yield pa.record_batch([pa.array(before, pa.int32()), *extra.columns[1:],
                                       pa.array([False] * extra.num_rows)],
                                      [*b.schema.names, "own"])

    return rows.mapInArrow(twice, "part int, doc_id long, text string, own boolean") \
        .repartition(max(1, min(len(first), tasks)), "part") \
        .sortWithinPartitions("part", F.desc("own"), F.desc_nulls_last("doc_id"), "text")


def with_edits(docs: DataFrame, parts: int | None = None, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of its
    fingerprint to the edited one's and to the next document's."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 8 * tasks  # several small ranges per task even out

    def result(doc_id: int | None, text: str, own: np.ndarray, nxt: str, other: np.ndarray) -> tuple:
        new = edited(text, nxt)
        data = new.encode()
        sigs = signatures(data, chain)
        return (doc_id, len(text), hashlib.sha256(data).hexdigest(), write(own), write(sigs),
                likeness(own, sigs), likeness(own, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, signatures) that waits for the next row
        closed = None  # part whose following head has come
        for b in batches:
            rows = []
            for part, doc_id, text, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not own and closed == part:
                    continue  # rows that tie with the head
                sigs = signatures(text.encode(), chain)
                if held is not None:
                    rows.append(result(*held[1:], text, sigs))
                held, closed = ((part, doc_id, text, sigs), None) if own else (None, part)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                     pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                  [x.split()[0] for x in OUT.split(", ")])

    return in_order(docs, parts, tasks).mapInArrow(run, OUT)


# ---- similarity join -------------------------------------------------------

def near_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """Pairs (left_fp, right_fp) of different fingerprints with a likeness of at
    least ``threshold``; ``members`` tells which documents have a fingerprint. Sets
    are dealt by length to ranges [q, q/threshold), so partners are in the same or
    the next range; candidates share one of their rarest signatures."""
    sets = cut_lineage(classes(docs, chain))
    rows = sets.select("fp", F.posexplode("sigs").alias("i", "sig"), F.size("sigs").alias("n"))
    freq = rows.groupBy("sig").agg(F.count("*").alias("f"))
    ranked = rows.join(freq, "sig").groupBy("fp", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "sig"))), lambda x: x["sig"]).alias("s"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    probes = ranked.select("fp", "n", level.alias("level"),
                           F.explode(F.slice(F.col("s"), F.lit(1), keep)).alias("sig"))
    left = probes.select("sig", F.col("fp").alias("left_fp"), F.col("n").alias("ln"), "level")
    right = probes.select("sig", F.col("fp").alias("right_fp"), F.col("n").alias("rn"),
                          F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"))
    fits = (F.col("ln") < F.col("rn")) | ((F.col("ln") == F.col("rn"))
                                         & (F.col("left_fp") < F.col("right_fp")))
    cand = left.join(right, ["sig", "level"]).filter(fits & (F.col("ln") >= F.col("rn") * threshold)) \
        .select("left_fp", "right_fp").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(np.array(x), np.array(y), threshold)
                    for x, y in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True)]
            yield pa.record_batch([b[0].filter(pa.array(keep)), b[1].filter(pa.array(keep))],
                                  ["left_fp", "right_fp"])

    return cand.join(sets.select(F.col("fp").alias("left_fp"), F.col("sigs").alias("a")), "left_fp") \
        .join(sets.select(F.col("fp").alias("right_fp"), F.col("sigs").alias("b")), "right_fp") \
        .select("left_fp", "right_fp", "a", "b").mapInArrow(check, "left_fp string, right_fp string")


def members(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, fp (SHA-256 of the fingerprint; null where it is empty) and sigs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signatures(t, chain) for t in b[1].cast(pa.binary()).to_pylist()]
            names = [hashlib.sha256(s.tobytes()).hexdigest() if len(s) else None for s in sets]
            yield pa.record_batch([b[0], pa.array(names, pa.string()),
                                   pa.array([s.astype(np.int64) for s in sets],
                                            pa.list_(pa.int64()))], ["doc_id", "fp", "sigs"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, fp string, sigs array<bigint>")


def classes(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """One row (fp, sigs) per fingerprint that is not empty."""
    return members(docs, chain).filter("fp is not null").groupBy("fp") \
        .agg(F.first("sigs").alias("sigs"))
