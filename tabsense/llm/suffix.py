"""Removal of byte strings of a given length that occur more than once.

A suffix array over the whole corpus would sort every byte position. Instead,
texts are first cut into phrases at anchors: the positions whose 16-byte hash is
the smallest of some window of 128. Which positions of a string are anchors
depends on the string alone, but for those near its ends, so two equal 400-byte
strings hold the same phrases inside. Phrases that occur once in the corpus
cannot lie in a repeat; the runs of the others are the segments, and a segment
is a string of phrase names.

The difference-cover algorithm sorts the suffixes of all segments: the triples
of names at two of three positions are sorted and named by their order, the
strings of these names are sorted by recursion, and the remaining suffixes are
merged in by their first name and the rank of what follows. It stops as soon as
names stand for as many phrases as the longest prefix has; the suffixes with long prefixes
(dense anchors, as in periodic text), which need a deeper recursion, are sorted apart.
Neighbours in suffix order whose
prefixes (all the phrases that any repeat through that anchor must hold) are equal are
candidates; all others are left behind.

An exact check of the bytes follows. All 400-byte strings that have an anchor as
their first share the 273 bytes after it (their core). Candidates with one core
whose bytes 127 before to 400 after the anchor all agree are settled at once. For
the others, the 400-byte strings are compared by 64-bit hashes; phrase names,
prefixes and cores are hashes of 62 bits and more, where a collision only adds a
candidate. In the final comparison, of n strings, n*n/2**65 pairs are expected to
collide.

Every exchange sends a key once per chunk of documents, ranks go to distinct
keys, and the rows of one key are joined by Spark's skew-aware join. The comparison of
neighbours deals positions by ranges of rank, though, so those of one hot passage (two
longs each) do meet in one task.

Defined cases: a null or empty text is empty bytes and keeps the hash of no
bytes; texts shorter than the length lose nothing; repeated rows remove each
other; an empty table gives an empty result; columns of the input that clash
with added ones are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, releasing, text_or_empty
from .exchange import Keys, answer_of, ask, buckets_for, freeze, make_chunks, pack_keys, thaw, unpack_keys

LENGTH, WINDOW, GRAM = 400, 128, 16
BLOCK = 1 << 18  # bytes that are hashed at once: some 100 bytes of arrays each
SHORT = 9  # phrases in the prefixes of those suffixes that two levels sort
TOP = (1 << 62) - 1
ALIKE, MIXED = 1, 2  # what is around a core that occurs more than once
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: a hash value per byte (odd multiples of a fixed constant, mixed)
BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(BASE)


class _Powers:
    """BASE**i and its inverse modulo 2**64, grown as texts need them."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, k, 1 << 64))])
                cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(INVERSE, k, 1 << 64))])
        return cls.up[:n], cls.down[:n]

    @classmethod
    def drop(cls) -> None:
        """The tables grow to those of the longest text; a worker outlives its task."""
        cls.up = cls.down = np.ones(1, np.uint64)
        release()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substring of a text, by start and end."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_mix(BYTE)[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.down[start]
                        + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], .. start[0] + size[0] - 1, start[1], .. one after the other."""
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(int(size.sum()))


def window_minima(h: Hashes, n: int, window: int) -> np.ndarray:
    """For every start of ``window`` grams, the last position of the smallest."""
    at = np.arange(n - GRAM + 1)
    key = h.of(at, at + GRAM) >> np.uint64(32) << np.uint64(32)
    key |= np.uint64(0xFFFFFFFF) - at.astype(np.uint64)
    width = 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[:len(key) - (window - width)], key[window - width:])
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)


class Phrases:
    """Anchors of the texts of a block, names of the phrases that begin at them (0
    at a text's last), and for each anchor the starts low..high-1 of strings of the
    given length whose first anchor it is. Positions count from the block's begin."""

    def __init__(self, texts: list[bytes], length: int, window: int) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data, self.begin = data, np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes >= length)
        self.hash = Hashes(data)
        if not len(long):
            self.row = self.anchors = self.low = self.high = self.phrases = np.zeros(0, np.int64)
            self.names = np.zeros(0, np.uint64)
            return
        windows = sizes[long] - window - GRAM + 2
        starts = _ranges(self.begin[long], windows)
        rows = np.repeat(long, windows)
        firsts = window_minima(self.hash, len(data), window)[starts]
        new = np.concatenate([[True], (firsts[1:] != firsts[:-1]) | (rows[1:] != rows[:-1])])
        self.row, self.anchors, self.low = rows[new], firsts[new], starts[new]
        last = np.append(self.row[1:] != self.row[:-1], True)
        edge = self.begin + sizes - length + 1
        self.high = np.where(last, edge[self.row], np.minimum(np.append(self.low[1:], 0),
                                                              edge[self.row]))
        following = np.where(last, self.anchors, np.append(self.anchors[1:], 0))
        self.names = np.where(last, np.uint64(0), self.hash.of(self.anchors, following)
                              >> np.uint64(1) | np.uint64(1))
        here = np.arange(len(self.anchors))
        ends = np.flatnonzero(last)
        final = ends[np.searchsorted(ends, here)]
        reach = self.anchors + (length - GRAM - 2 * window + 2)
        self.phrases = np.minimum(np.searchsorted(self.anchors, reach, "right") - 1, final) - here


def _texts(blob: bytes) -> list[bytes]:
    return thaw(blob).column(1).cast(pa.binary()).to_pylist()


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of items of about BLOCK bytes each, one at least."""
    at = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > BLOCK:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _phrases(blob: bytes, length: int, window: int) -> Iterator[tuple[int, Phrases]]:
    texts = _texts(blob)
    for i, j in _blocks([len(t) for t in texts]):
        yield i, Phrases(texts[i:j], length, window)


def _names(blob: bytes, length: int, window: int) -> np.ndarray:
    found = [p.names[p.names > 0] for _, p in _phrases(blob, length, window)]
    return np.concatenate([np.zeros(0, np.uint64), *found])


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones (sorted)."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _distinct(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the number of times each occurs and, per extra column,
    the largest value."""
    if not values:
        found, count = np.unique(keys, return_counts=True)
        return found, count[:, None].astype(np.int64)
    order = np.argsort(keys)
    found, first, count = np.unique(keys[order], return_index=True, return_counts=True)
    out = np.zeros((len(found), 1 + len(values)), np.int64)
    out[:, 0] = count
    for k, v in enumerate(values, 1):
        if len(found):
            out[:, k] = np.maximum.reduceat(v[order], first)
    return found, out


SEGMENT = pa.schema([("row", pa.int64()), ("base", pa.int64()), ("text", pa.binary()),
                     ("steps", pa.list_(pa.int32())), ("back", pa.list_(pa.int32())),
                     ("starts", pa.list_(pa.int32())), ("names", pa.list_(pa.int64())),
                     ("prefix", pa.list_(pa.int64())), ("phrases", pa.list_(pa.int32()))])
#: read by the search for candidates alone: hashes, which no compression shortens, are
#: kept apart from what the exact check carries on
KEYS = ["names", "prefix", "phrases"]


def segments_of(p: Phrases, at: int, repeated: np.ndarray, length: int,
                window: int) -> tuple[pa.Table, int]:
    """Runs of phrases that are in ``repeated`` (sorted names) with at least one
    possible start, and the most phrases in a prefix. ``base`` is the kept slice's
    place in its text (row ``at`` + its number in the block); ``steps`` are the distances
    to the anchor before or the slice's begin, ``back`` those to the first start, and
    ``starts`` the number of starts (small numbers, as the exact check carries them on);
    ``prefix`` is the hash of an anchor's prefix and ``phrases`` the number of phrases in
    it, 0 where a phrase of it is not repeated or no string has it first."""
    here = np.arange(len(p.anchors))
    common = _among(p.names, repeated) & (p.names > 0)
    gaps = np.append(np.flatnonzero(~common), len(here))  # every text's last anchor is one
    run = gaps[np.searchsorted(gaps, here)] - here
    start = (run >= p.phrases) & (p.phrases > 0) & (p.high > p.low)
    if not start.any():
        return SEGMENT.empty_table(), 0
    until = here + p.phrases
    prefix = np.where(start, (p.hash.of(p.anchors, np.maximum(p.anchors[until], p.anchors))
                              >> np.uint64(1) | np.uint64(1)).astype(np.int64), 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], common, [False]]).astype(np.int8)))
    first, stop = edges[::2], edges[1::2]  # phrases first..stop-1, anchors first..stop
    some = np.add.reduceat(start, first, dtype=np.int64) > 0
    # reduceat runs on to the next run; no start lies between two runs
    first, stop = first[some], stop[some]
    row = p.row[first]
    base = np.maximum(p.begin[row], p.anchors[first] - window + 1)
    size_of = np.append(p.begin[1:], len(p.data))
    end = np.minimum(size_of[row], p.anchors[stop] + length)
    count = stop - first + 1
    flat = _ranges(first, count)
    less = np.repeat(base, count)

    def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    place = p.anchors[flat] - less
    steps = np.diff(place, prepend=0)
    begins = np.cumsum(count) - count
    steps[begins] = place[begins]

    cols = [pa.array(row + at, pa.int64()), pa.array(base - p.begin[row], pa.int64()),
            pa.array([p.data[i:j].tobytes() for i, j in zip(base, end, strict=True)], pa.binary()),
            lists(steps, count, pa.int32()), lists((p.anchors - p.low)[flat], count, pa.int32()),
            lists(np.maximum(p.high - p.low, 0)[flat], count, pa.int32()),
            lists(p.names[_ranges(first, count - 1)].astype(np.int64), count - 1, pa.int64()),
            lists(prefix[flat], count, pa.int64()),
            lists(np.where(start, p.phrases, 0)[flat], count, pa.int32())]
    return pa.Table.from_arrays(cols, schema=SEGMENT), int(p.phrases[start].max())


# ---- difference cover ----------------------------------------------------

def _rows(cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and the lists' sizes."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _behind(values: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The value k places on, -1 beyond the string's end (``left``: places up to it)."""
    return np.where(left > k, np.append(values[k:], np.full(min(k, len(values)), -1)), -1)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples at the positions 1 and 2 modulo 3 of each string; those of either
    kind make a string of the next level."""
    for b in batches:
        s, size = _flat(b[2])
        i = _ranges(np.zeros(len(size), np.int64), size)
        left = np.repeat(size, size) - i
        pick = i % 3 > 0
        chunk, seg = (np.repeat(c.to_numpy(), size)[pick] for c in b.columns[:2])
        at = i[pick]
        yield _rows([chunk, 2 * seg + at % 3 - 1, at // 3, s[pick], _behind(s, left, 1)[pick],
                     _behind(s, left, 2)[pick]], ["chunk", "seg", "i", "a", "b", "c"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every suffix its first two names and the two ranks with which it can be
    compared: for position modulo 3 = 0 those of the next two, for 1 its own and
    the next, for 2 its own and the next but one. A string comes with the ranks of
    its sample as parts of kind 0 (itself), 1 and 2."""
    for b in batches:
        parts = b[2].flatten()
        kind = parts.field(0).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(b.num_rows), np.diff(b[2].offsets.to_numpy()))
        values, sizes = _flat(parts.field(1))
        begin = np.cumsum(sizes) - sizes
        own = np.flatnonzero(kind == 0)
        size = np.zeros(b.num_rows, np.int64)
        size[owner[own]] = sizes[own]
        place = np.cumsum(size) - size
        s, r = np.zeros(size.sum(), np.int64), np.full(size.sum(), -1)
        for k in (0, 1, 2):
            which = np.flatnonzero(kind == k)
            source = _ranges(begin[which], sizes[which])
            j = _ranges(np.zeros(len(which), np.int64), sizes[which])
            target = np.repeat(place[owner[which]], sizes[which]) + (3 * j + k if k else j)
            (r if k else s)[target] = values[source]
        i = _ranges(np.zeros(len(size), np.int64), size)
        left = np.repeat(size, size) - i
        m = i % 3
        one, two = _behind(r, left, 1), _behind(r, left, 2)
        chunk, seg = (np.repeat(c.to_numpy(), size) for c in b.columns[:2])
        yield _rows([chunk, seg, i, m, s, _behind(s, left, 1), np.where(m == 0, one, r),
                     np.where(m == 1, one, two)], ["chunk", "seg", "i", "m", "a", "b", "u", "v"])


def _compare(x: tuple[int, int, int], y: tuple[int, int, int]) -> int:
    """Order of two suffixes (m, u, v) whose first two names are equal, by the
    rank at the first distance at which both have one."""
    if x[0] and y[0] or x[0] == y[0]:
        p, q = x[1], y[1]
    elif x[0]:
        p, q = x[2], y[1 if x[0] == 1 else 2]
    else:
        p, q = x[1 if y[0] == 1 else 2], y[2]
    return (p > q) - (p < q)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the distinct suffixes of a range of first names, sorted by these."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    m, a, b, u, v = (rows.column(k).to_numpy() for k in ("m", "a", "b", "u", "v"))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(a)))
    order, step = np.arange(len(a)), new.copy()
    key = cmp_to_key(_compare)
    for at, size in zip(first[sizes > 1], sizes[sizes > 1], strict=True):
        group = [(x, k) for k, x in enumerate(zip(m[at:at + size].tolist(), u[at:at + size].tolist(),
                                                  v[at:at + size].tolist(), strict=True))]
        group.sort(key=lambda x: key(x[0]))
        order[at:at + size] = [at + k for _, k in group]
        step[at + 1:at + size] = [_compare(x, y) != 0 for (x, _), (y, _)
                                  in zip(group, group[1:], strict=False)]
    rank = (np.cumsum(step) - 1) + (TaskContext.get().partitionId() << 36)
    yield _rows([*[c[order] for c in (m, a, b, u, v)], rank], ["m", "a", "b", "u", "v", "rank"])


def _strings(rows: DataFrame, name: str) -> DataFrame:
    """Rows (chunk, seg, i, name) as one array ``s`` per string."""
    return rows.groupBy("chunk", "seg").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", name))), lambda x: x[name]).alias("s"))


TRIPLES = "chunk long, seg long, i long, a long, b long, c long"


def suffix_ranks(strings: DataFrame, depth: int, triples: DataFrame | None = None) -> DataFrame:
    """For strings (chunk, seg, s: array of names from 0) the rank of every suffix,
    as an array in place of ``s``: order-preserving numbers, in the order of at
    least the first 3**depth names. ``triples``: what ``_sample`` makes of the strings."""
    if depth == 0:
        return strings
    if triples is None:
        triples = strings.mapInArrow(_sample, TRIPLES)
    named = cut_lineage(triples.select("a", "b", "c").distinct().repartitionByRange("a", "b", "c")
                        .sortWithinPartitions("a", "b", "c")
                        .withColumn("name", F.monotonically_increasing_id()))
    sample = suffix_ranks(cut_lineage(_strings(triples.join(named, ["a", "b", "c"]), "name")),
                          depth - 1)
    parts = strings.select("chunk", "seg", F.lit(0).alias("kind"), "s").unionByName(sample.select(
        "chunk", F.shiftright("seg", 1).alias("seg"),
        (F.col("seg").bitwiseAND(1) + 1).cast("int").alias("kind"), "s"))
    described = parts.groupBy("chunk", "seg").agg(F.collect_list(F.struct("kind", "s"))) \
        .mapInArrow(_describe, "chunk long, seg long, i long, m long, a long, b long, u long, v long")
    key = ["m", "a", "b", "u", "v"]
    merged = cut_lineage(described.select(key).distinct().repartitionByRange("a", "b")
                         .sortWithinPartitions("a", "b")
                         .mapInArrow(_merge, "m long, a long, b long, u long, v long, rank long"))
    return cut_lineage(_strings(described.join(merged, key), "rank"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order, those whose prefix is that of the one before or after.
    The first and last of a range have neighbours elsewhere and stay."""
    held = None
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield from _equal(held, before, b[0][0].as_py())
            before = held[0][held.num_rows - 1].as_py()
        held = b
    if held is not None:
        yield from _equal(held, before, None)


def _equal(b: pa.RecordBatch, before: int | None, after: int | None) -> Iterator[pa.RecordBatch]:
    p = b[0].to_numpy()
    same = p[1:] == p[:-1]
    keep = np.zeros(len(p), bool)
    keep[1:] |= same
    keep[:-1] |= same
    keep[0] |= before is None or before == p[0]
    keep[-1] |= after is None or after == p[-1]
    yield pa.record_batch([c.filter(pa.array(keep)) for c in b.columns[1:]], ["chunk", "seg", "i"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = [pack_keys(np.sort(x.values.to_numpy().view(np.uint64))) for x in b[1]]
        yield pa.record_batch([b[0], pa.array(marks, pa.binary())], ["chunk", "marks"])


def candidates(segments: DataFrame, most: int) -> DataFrame:
    """(chunk, marks: sorted seg << 32 | i, packed): anchors whose prefix another suffix
    shares, by comparison of neighbours in suffix order. ``segments``: chunk, keys;
    ``most``: phrases in the longest prefix. Equal prefixes have as many phrases, so
    suffixes with short prefixes and those with long ones are sorted apart: few segments
    hold any of the latter."""
    found = _sharing(segments, 1, min(most, SHORT))
    if most > SHORT:
        found = found.unionByName(_sharing(segments, SHORT + 1, most))
    return found.groupBy("chunk").agg(F.collect_list(F.shiftleft("seg", 32).bitwiseOR(F.col("i")))) \
        .mapInArrow(_packed, "chunk long, marks binary")


def _sharing(segments: DataFrame, least: int, most: int) -> DataFrame:
    """(chunk, seg, i) of the candidates with ``least`` to ``most`` phrases in their prefix,
    found in the order of at least so many names; only segments that hold such a suffix
    are read."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                t = thaw(blob).combine_chunks()
                phrases = t.column("phrases").combine_chunks()
                count, sizes = _flat(phrases)
                here = (count >= least) & (count <= most)
                own = np.repeat(np.arange(len(sizes)), sizes)
                seg = np.unique(own[here])
                if not len(seg):
                    continue
                prefix = t.column("prefix").combine_chunks()
                kept = np.where(here, prefix.flatten().to_numpy(zero_copy_only=False), 0)
                kept = pa.ListArray.from_arrays(phrases.offsets, pa.array(kept, pa.int64()))
                yield pa.record_batch(
                    [pa.array(np.full(len(seg), chunk)), pa.array(seg),
                     t.column("names").combine_chunks().take(pa.array(seg)), kept.take(pa.array(seg))],
                    ["chunk", "seg", "s", "prefix"])

    rows = segments.mapInArrow(explode, "chunk long, seg long, s array<bigint>, prefix array<bigint>")
    # one function: two in a row would hold two Python workers per core
    triples = segments.mapInArrow(lambda batches: _sample(explode(batches)), TRIPLES)
    depth = next(d for d in range(64) if 3 ** d >= most)
    ranks = suffix_ranks(rows.select("chunk", "seg", "s"), depth, triples)
    found = rows.select("chunk", "seg", "prefix").join(ranks, ["chunk", "seg"]).select(
        "chunk", "seg", F.posexplode(F.arrays_zip("s", "prefix")).alias("i", "x")) \
        .filter("x.prefix <> 0 and x.s is not null") \
        .select(F.col("x.prefix").alias("prefix"), "chunk", "seg", "i", F.col("x.s").alias("rank"))
    return found.repartitionByRange("rank").sortWithinPartitions("rank", "prefix") \
        .select("prefix", "chunk", "seg", "i") \
        .mapInArrow(_neighbours, "chunk long, seg long, i int")


# ---- exact check ---------------------------------------------------------

class Checked:
    """The marked anchors of a chunk: core (hash of the bytes that all its strings
    hold), hash of the bytes around each, and the starts it stands for."""

    def __init__(self, blob: bytes, marks: bytes, length: int, window: int) -> None:
        self.table, self.length = thaw(blob).combine_chunks(), length
        first = self._offsets("steps")
        marked = unpack_keys(marks).astype(np.int64)
        self.seg = marked >> 32
        self.at = first[self.seg] + (marked & 0xFFFFFFFF)
        steps, sizes = self._values("steps").astype(np.int64), np.diff(first)
        anchors = np.cumsum(steps)
        anchors -= np.repeat(anchors[first[:-1]] - steps[first[:-1]], sizes)
        self.anchor = anchors[self.at]
        self.core = np.zeros(len(self.at), np.uint64)
        self.around = np.zeros(len(self.at), np.int64)
        for here, h, begin, end in self._texts():
            anchor = begin + self.anchor[here]
            self.core[here] = h.of(anchor, np.minimum(end, anchor + length - window + 1))
            self.around[here] = (h.of(np.maximum(begin, anchor - window + 1),
                                      np.minimum(end, anchor + length)) >> np.uint64(2))

    def _offsets(self, column: str) -> np.ndarray:
        return self.table.column(column).combine_chunks().offsets.to_numpy().astype(np.int64)

    def _values(self, column: str) -> np.ndarray:
        return self.table.column(column).combine_chunks().values.to_numpy(zero_copy_only=False)

    def _texts(self) -> Iterator[tuple[np.ndarray, Hashes, np.ndarray, np.ndarray]]:
        """By blocks of segments: the marked anchors in it, the hashes of its bytes,
        and where each anchor's slice begins and ends there."""
        texts = self.table.column("text").to_pylist()
        for i, j in _blocks([len(t) for t in texts]):
            here = np.flatnonzero((self.seg >= i) & (self.seg < j))
            if len(here):
                sizes = np.array([len(t) for t in texts[i:j]], np.int64)
                begin = (np.cumsum(sizes) - sizes)[self.seg[here] - i]
                data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                yield here, Hashes(data), begin, begin + sizes[self.seg[here] - i]

    def core_keys(self) -> Keys:
        return {0: _distinct(self.core, self.around, TOP - self.around)}

    def sort(self, answers: list) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors are settled as repeated, and which need their strings
        compared: those whose core occurs with different surroundings."""
        found = answer_of(answers, 0, 1)[np.searchsorted(np.unique(self.core), self.core), 0]
        return found == ALIKE, found == MIXED

    def _ranges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts low..high-1 (in their slices) of the given marked anchors' strings."""
        low = self.anchor[which] - self._values("back")[self.at[which]]
        return low, low + self._values("starts")[self.at[which]]

    def _places(self, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row, and place in its text, of the given segments' slices."""
        return self.table.column("row").to_numpy()[seg], self.table.column("base").to_numpy()[seg]

    def covered(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of what the strings of the anchors in ``which`` cover."""
        low, high = self._ranges(which)
        row, base = self._places(self.seg[which])
        some = high > low
        return row[some], (base + low)[some], (base + high - 1 + self.length)[some]

    def strings(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, start in its text, hash) of the same strings, by blocks: there may be as
        many as bytes."""
        chosen = np.zeros(len(self.at), bool)
        chosen[which] = True
        for here, h, begin, _ in self._texts():
            some = chosen[here]
            low, high = self._ranges(here[some])
            size = high - low
            start = _ranges(low, size)
            at = start + np.repeat(begin[some], size)
            row, base = self._places(np.repeat(self.seg[here[some]], size))
            yield row, base + start, h.of(at, at + self.length)

    def keys(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the same strings."""
        return np.concatenate([np.zeros(0, np.uint64), *[k for _, _, k in self.strings(which)]])


def _twice(totals: np.ndarray) -> np.ndarray:
    """1 for keys that occur more than once, else 0."""
    return (totals[:, :1] >= 2).astype(np.int64)


def _surroundings(totals: np.ndarray) -> np.ndarray:
    """ALIKE or MIXED for cores that occur more than once, by whether the largest and
    the smallest hash of what is around them are one; else 0."""
    return _twice(totals) * np.where(totals[:, 1:2] == TOP - totals[:, 2:3], ALIKE, MIXED)


def _union(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs (row, begin, end) of what the given ones cover."""
    if not len(rows):
        return rows, begin, end
    order = np.argsort(rows << 32 | begin)
    low, high = ((rows << 32 | x)[order] for x in (begin, end))
    high = np.maximum.accumulate(high)  # of a row's, as the next row's are all larger
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    low, high = low[first], high[np.append(first[1:], len(high)) - 1]
    return low >> 32, low & 0xFFFFFFFF, high & 0xFFFFFFFF


def repeated_spans(chunks: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(chunk, spans: array of (row, begin, end)): what repeated strings cover in
    the documents of each chunk; spans of different segments may overlap."""
    buckets = buckets_for(chunks)

    def names(blob: bytes) -> Keys:
        return {0: _distinct(_mix(_names(blob, length, window)))}

    answers, _ = ask(chunks, names, 1, buckets, verdict=_twice, last=_Powers.drop)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, got in zip(*[c.to_pylist() for c in b.columns], strict=True):
                every = _names(blob, length, window)
                known, first = np.unique(_mix(every), return_index=True)
                repeated = np.sort(every[first[answer_of(got, 0, 1)[:, 0] > 0]])
                found = [segments_of(p, at, repeated, length, window)
                         for at, p in _phrases(blob, length, window)]
                table = pa.concat_tables([t for t, _ in found])
                if table.num_rows:
                    yield pa.record_batch([pa.array([chunk], pa.int64()),
                                           pa.array([max(m for _, m in found)], pa.int64()),
                                           pa.array([freeze(table.drop_columns(KEYS))], pa.binary()),
                                           pa.array([freeze(table.select(KEYS))], pa.binary())],
                                          ["chunk", "most", "blob", "keys"])

    held = cut_lineage(chunks.select("chunk", "blob").join(answers, "chunk")
                       .select("chunk", "blob", "answers")
                       .mapInArrow(releasing(segments, _Powers.drop),
                                   "chunk long, most long, blob binary, keys binary"))
    most = held.agg(F.max("most")).first()[0] or 1
    marked = cut_lineage(held.select("chunk", "blob")
                         .join(candidates(held.select("chunk", "keys"), most), "chunk"))
    # the marked table is a chunk table of its own: two questions about it
    alike, _ = ask(marked, lambda blob, marks: Checked(blob, marks, length, window).core_keys(),
                   3, buckets, "marks", (1, 2), _surroundings, _Powers.drop)
    sorted_out = cut_lineage(marked.join(alike, "chunk"))

    def strings(blob: bytes, extra: dict) -> Keys:
        c = Checked(blob, extra["marks"], length, window)
        return {0: _distinct(c.keys(np.flatnonzero(c.sort(extra["answers"])[1])))}

    again, _ = ask(sorted_out.select("chunk", "blob", F.struct("marks", "answers").alias("extra")),
                   strings, 1, buckets, "extra", verdict=_twice, last=_Powers.drop)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, marks, first, second in zip(*[c.to_pylist() for c in b.columns],
                                                         strict=True):
                c = Checked(blob, marks, length, window)
                settled, open_ = (np.flatnonzero(x) for x in c.sort(first))
                twice = np.unique(c.keys(open_))[answer_of(second, 0, 1)[:, 0] > 0]
                found = [c.covered(settled)]
                for row, start, key in c.strings(open_):
                    gone = _among(key, twice)
                    found.append(_union(row[gone], start[gone], start[gone] + length))
                runs = _union(*[np.concatenate(x) for x in zip(*found, strict=True)])
                out = [{"row": r, "begin": i, "end": j}
                       for r, i, j in zip(*[x.tolist() for x in runs], strict=True)]
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([out], SPANS)],
                                      ["chunk", "spans"])

    return sorted_out.withColumnRenamed("answers", "first") \
        .join(again.withColumnRenamed("answers", "second"), "chunk", "left") \
        .select("chunk", "blob", "marks", "first", "second") \
        .mapInArrow(releasing(spans, _Powers.drop), "chunk long, spans array<struct<row:int,begin:int,end:int>>")


SPANS = pa.list_(pa.struct([("row", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))


def _cleaned(docs: DataFrame, length: int, window: int, carry: tuple[str, ...],
             out: Callable[[pa.Table, list[bytes], list[bytes], list[int]], pa.RecordBatch],
             schema: str) -> DataFrame:
    """What ``out`` makes of each chunk's rows (doc_id, text and the columns named in
    ``carry``), their texts' bytes, what remains of each and how many runs it loses. A
    second function behind this one would hold a second Python worker per core."""
    chunks = make_chunks(_rows_of(docs, carry))
    found = repeated_spans(chunks, length, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, spans in zip(*[c.to_pylist() for c in b.columns], strict=True):
                table = thaw(blob)
                by: dict[int, list[tuple[int, int]]] = {}
                for s in spans or []:
                    by.setdefault(s["row"], []).append((s["begin"], s["end"]))
                texts = table.column(1).cast(pa.binary()).to_pylist()
                kept, count = [], []
                for row, text in enumerate(texts):
                    parts, at, runs = [], 0, 0
                    for begin, end in sorted(by.get(row, [])):
                        if begin > at or not runs:
                            parts.append(text[at:begin])
                            runs += 1
                        at = max(at, end)
                    kept.append(b"".join([*parts, text[at:]]))
                    count.append(runs)
                yield out(table.combine_chunks(), texts, kept, count)

    return chunks.join(found, "chunk", "left").select("blob", "spans") \
        .mapInArrow(releasing(run), schema)


def _rows_of(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"),
                       *[F.col(f"`{c}`") for c in carry])


def _columns(table: pa.Table, first: int = 0) -> list[pa.Array]:
    return [c.combine_chunks() for c in table.columns[first:]]


def dedup(docs: DataFrame, length: int = LENGTH, window: int = WINDOW,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the remaining bytes (binary
    column ``kept``) and the columns named in ``carry``, for every row."""
    digests = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    names = [x.split()[0] for x in digests.split(", ")]

    def out(table: pa.Table, texts: list[bytes], kept: list[bytes],
            count: list[int]) -> pa.RecordBatch:
        removed = [len(t) - len(k) for t, k in zip(texts, kept, strict=True)]
        return pa.record_batch(
            [*_columns(table)[:1], pa.array([len(t) for t in texts], pa.int64()),
             pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
             pa.array(kept, pa.binary()), *_columns(table, 2)], [*names, *carry])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in _rows_of(docs, carry).schema[2:]]
    return _cleaned(docs, length, window, carry, out, ", ".join([digests, *fields]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with columns doc_id, text, lang, source, n_chars; text
    loses what ``dedup`` removes (and what is left of a character that a cut
    divides), n_chars follows."""
    def out(table: pa.Table, texts: list[bytes], kept: list[bytes],
            count: list[int]) -> pa.RecordBatch:
        left = [k.decode("utf-8", "ignore") for k in kept]
        doc_id, _, lang, source = _columns(table)
        return pa.record_batch([doc_id, pa.array(left, pa.string()), lang, source,
                                pa.array([len(t) for t in left], pa.int64())],
                               ["doc_id", "text", "lang", "source", "n_chars"])

    return _cleaned(docs, LENGTH, WINDOW, ("lang", "source"), out,
                    "doc_id long, text string, lang string, source string, n_chars long")
