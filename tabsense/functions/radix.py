"""Order statistics by radix selection over the bits of doubles.

A double's bits, with all but the sign bit flipped for negative numbers, are a 64-bit
integer in the same order. A bracket is a range of keys around a wanted rank; its bits
below the common prefix of its ends are split ``bits`` at a time. One pass counts the
values of every bracket by the next bits, with the smallest and largest key of each
bin: tasks count their Arrow batches in NumPy and send at most 2**bits rows per
bracket, Spark adds these up and finds the bin that holds the rank, and that bin's
smallest and largest key are the next bracket. Every pass settles ``bits`` more bits, so
64 / bits passes (six for 12) end it whatever the values are; equal ends end it sooner.
Ranks that fall into one bin share a bracket.

``select_columns`` has a series per column, ``select_groups`` one per group of a
bounded number of groups, whose numbers are joined by broadcast.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 12
COLUMNS = 64              # columns per job: bounds a task's counters
HELD = 1_000_000          # cells of groups that a task holds before it sends them
_LOW = np.int64(0x7FFF_FFFF_FFFF_FFFF)
_SIGN = np.uint64(1 << 63)
CELL = "series int, slot int, bin int, c long, lo long, hi long"
_CELL = ["series", "slot", "bin", "c", "lo", "hi"]


def keys_of(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the order of the doubles; -0.0 and 0.0 have one."""
    raw = (values + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ _LOW, raw)


def value_of(key: int) -> float:
    raw = np.int64(key)
    return float((raw ^ _LOW if raw < 0 else raw).view(np.float64))


@dataclass
class Bracket:
    """Keys lo..hi of a series, and the ranks wanted among them (rank there -> rank in
    the series)."""

    series: int
    lo: int = -(1 << 63)
    hi: int = (1 << 63) - 1
    ranks: dict[int, int] = field(default_factory=dict)

    def cut(self, bits: int) -> tuple[int, int, int]:
        """(bits below the common prefix, shift of the bins, prefix)."""
        lo, hi = self.lo ^ -(1 << 63), self.hi ^ -(1 << 63)
        lo, hi = lo & (1 << 64) - 1, hi & (1 << 64) - 1
        top = (lo ^ hi).bit_length()
        return top, max(0, top - bits), lo >> top


def _bins(unsigned: np.ndarray, top, shift, prefix) -> tuple[np.ndarray, np.ndarray]:
    """Which keys have the prefix, and their bins. The arguments are numbers, or arrays
    with one entry per key."""
    top, shift = np.asarray(top, np.uint64), np.asarray(shift, np.uint64)
    # a shift by 64 is none; two smaller ones are
    half = top // np.uint64(2)
    inside = (unsigned >> half >> (top - half)) == np.asarray(prefix, np.uint64)
    with np.errstate(over="ignore"):
        mask = np.where(top - shift >= np.uint64(64), ~np.uint64(0),
                        (np.uint64(1) << (top - shift)) - np.uint64(1))
    return inside, ((unsigned >> shift) & mask).astype(np.int64)


def _cells(series, slot, bins, c, lo, hi) -> pa.RecordBatch:
    n = len(bins)
    full = [np.full(n, x, np.int32) if np.isscalar(x) else x.astype(np.int32) for x in (series, slot)]
    return pa.record_batch([pa.array(full[0]), pa.array(full[1]), pa.array(bins.astype(np.int32)),
                            pa.array(c), pa.array(lo), pa.array(hi)], _CELL)


def _count_columns(brackets: list[Bracket], bits: int, first: int
                   ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counter of a task over double columns; column k is series ``first`` + k."""
    by_series: dict[int, list[tuple[int, Bracket]]] = {}
    for slot, b in sorted(_slots(brackets), key=lambda sb: sb[1].lo):
        by_series.setdefault(b.series, []).append((slot, b))
    # a series' brackets are apart: a key is held only against the one it may lie in
    plan = {series: (np.array([b.lo for _, b in own], np.int64),
                     *(np.array(x, np.uint64) for x in zip(*[b.cut(bits) for _, b in own], strict=True)),
                     np.array([slot for slot, _ in own])) for series, own in by_series.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {series: len(los) << bits for series, (los, *_) in plan.items()}
        c = {series: np.zeros(n, np.int64) for series, n in cells.items()}
        lo = {series: np.full(n, np.iinfo(np.int64).max) for series, n in cells.items()}
        hi = {series: np.full(n, np.iinfo(np.int64).min) for series, n in cells.items()}
        for batch in batches:
            for series, (los, top, shift, prefix, _) in plan.items():
                values = batch[series - first].to_numpy(zero_copy_only=False)
                keys = keys_of(values[~np.isnan(values)])
                at = np.searchsorted(los, keys, side="right") - 1
                keys, at = keys[at >= 0], at[at >= 0]
                inside, bins = _bins(keys.view(np.uint64) ^ _SIGN, top[at], shift[at], prefix[at])
                cell = (at << bits | bins)[inside]
                keys = keys[inside]
                np.add.at(c[series], cell, 1)
                np.minimum.at(lo[series], cell, keys)
                np.maximum.at(hi[series], cell, keys)
        for series, (*_, slots) in plan.items():
            met = np.flatnonzero(c[series])
            yield _cells(series, slots[met >> bits], met & (1 << bits) - 1, c[series][met], lo[series][met],
                         hi[series][met])

    return run


def _count_groups(brackets: list[Bracket], bits: int, n_series: int
                  ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over rows (series, v): cells are counted sparsely."""
    slots = _slots(brackets)
    deep = 1 + max(s for s, _ in slots)
    # a series without a bracket in a slot has a prefix that no key has
    cuts = np.zeros((deep, 3, n_series), np.uint64)
    cuts[:, 2] = np.iinfo(np.uint64).max
    for s, b in slots:
        cuts[s, :, b.series] = b.cut(bits)

    def summed(cells: list[tuple]) -> list[tuple]:
        cell, c, lo, hi = (np.concatenate(x) for x in zip(*cells, strict=True))
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        return [(cell[at], np.add.reduceat(c[order], at), np.minimum.reduceat(lo[order], at),
                 np.maximum.reduceat(hi[order], at))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for cell, c, lo, hi in held and summed(held):
                series, slot = np.divmod(cell >> bits, deep)
                yield _cells(series, slot, cell & (1 << bits) - 1, c, lo, hi)

        for batch in batches:
            series = batch[0].to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch[1].to_numpy(zero_copy_only=False)
            ok = ~np.isnan(values)
            series, keys = series[ok], keys_of(values[ok])
            unsigned = keys.view(np.uint64) ^ _SIGN
            for slot in range(deep):
                inside, bins = _bins(unsigned, *(x[series] for x in cuts[slot]))
                if inside.any():
                    cell = ((series * deep + slot) << bits | bins)[inside]
                    k = keys[inside]
                    held += summed([(cell, np.ones(len(cell), np.int64), k, k)])
                    size += len(held[-1][0])
            if size > HELD:
                held = summed(held)
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from out()
                    held, size = [], 0
        yield from out()

    return run


def _slots(brackets: list[Bracket]) -> list[tuple[int, Bracket]]:
    """Brackets numbered within their series."""
    met: dict[int, int] = {}
    out = []
    for b in brackets:
        met[b.series] = met.get(b.series, -1) + 1
        out.append((met[b.series], b))
    return out


def _ranks_of(n: int, probs: list[float]) -> list[int]:
    out = []
    for p in probs:
        k = math.floor((n - 1) * p)
        out += [k, min(k + 1, n - 1)]
    return sorted(set(out))


def _added(cells: DataFrame) -> DataFrame:
    """Cells of all tasks, with the number of values up to each and of the bracket."""
    total = Window.partitionBy("series", "slot")
    return cells.groupBy("series", "slot", "bin").agg(
        F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")) \
        .withColumn("upto", F.sum("c").over(total.orderBy("bin"))) \
        .withColumn("n", F.sum("c").over(total))


def _select(spark, count: Callable[[list[Bracket]], DataFrame], n_series: int, probs: list[float]
            ) -> tuple[dict[int, int], dict[tuple[int, int], float], int]:
    """Values per series, the wanted order statistics by (series, rank), and how many
    passes it took."""
    def hit(p: Column) -> Column:
        k = F.floor((F.col("n") - 1) * p)
        low = F.col("upto") - F.col("c")
        after = F.least(k + 1, F.col("n") - 1)
        return ((low <= k) & (k < F.col("upto"))) | ((low <= after) & (after < F.col("upto")))

    # one expression over the list: a clause per share outgrows what Spark compiles
    first = F.exists(F.array(*[F.lit(float(p)) for p in probs]), hit) if probs else F.lit(False)
    sizes: dict[int, int] = {}
    todo: list[Bracket] = []
    done: dict[tuple[int, int], float] = {}

    def follow(series: int, row, ranks: dict[int, int]) -> None:
        """The next bracket of a bin: its ranks count from its first value."""
        before = row["upto"] - row["c"]
        own = {r - before: rank for r, rank in ranks.items() if before <= r < row["upto"]}
        if row["lo"] == row["hi"]:
            done.update({(series, rank): value_of(row["lo"]) for rank in own.values()})
        elif own:
            todo.append(Bracket(series, row["lo"], row["hi"], own))

    for row in _added(count([Bracket(i) for i in range(n_series)])).where(first).collect():
        sizes[row["series"]] = row["n"]
        follow(row["series"], row, {r: r for r in _ranks_of(row["n"], probs)})
    passes = 1
    while todo:
        at = {(b.series, s): b for s, b in _slots(todo)}
        # a few ranks per series and slot: the table that the cells are held against
        wanted = spark.createDataFrame([(i, s, r) for (i, s), b in at.items() for r in b.ranks],
                                       "series int, slot int, rank long")
        asked, todo = todo, []
        cells = _added(count(asked)).join(F.broadcast(wanted), ["series", "slot"]) \
            .where((F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("upto"))) \
            .drop("rank").distinct()
        for row in cells.collect():
            follow(row["series"], row, at[row["series"], row["slot"]].ranks)
        passes += 1
    return sizes, done, passes


def interpolated(n: int, rank_value: Callable[[int], float], p: float) -> float:
    h = (n - 1) * p
    k = math.floor(h)
    v0, v1 = rank_value(k), rank_value(min(k + 1, n - 1))
    return v0 if v0 == v1 or h == k else v0 + (h - k) * (v1 - v0)


def select_columns(df: DataFrame, columns: list[Column], probs: list[float], bits: int = BITS
                   ) -> tuple[list[list[float] | None], int]:
    """Quantiles of double columns (None without values; null and NaN are none), and the
    passes over the data that the slowest share of the columns took."""
    out: list[list[float] | None] = []
    most = 0
    for first in range(0, len(columns), COLUMNS):
        some = columns[first:first + COLUMNS]
        data = df.select(*[c.alias(f"c{k}") for k, c in enumerate(some)])
        sizes, found, passes = _select(
            df.sparkSession, lambda b: data.mapInArrow(_count_columns(b, bits, 0), CELL),  # noqa: B023
            len(some), probs)
        most = max(most, passes)
        out += [[interpolated(sizes[i], lambda k, i=i: found[i, k], p) for p in probs]  # noqa: B023
                if i in sizes else None for i in range(len(some))]
    return out, most


def select_groups(rows: DataFrame, n_series: int, probs: list[float], bits: int = BITS
                  ) -> tuple[dict[int, tuple[int, list[float]]], int]:
    """{series: (values, quantiles)} of rows (series: 0..n_series-1, v: double), and the
    passes. Every pass sends at most 2**bits cells per bracket, task and flush."""
    sizes, found, passes = _select(
        rows.sparkSession, lambda b: rows.select("series", "v").mapInArrow(
            _count_groups(b, bits, n_series), CELL), n_series, probs)
    return {i: (n, [interpolated(n, lambda k, i=i: found[i, k], p) for p in probs])
            for i, n in sizes.items()}, passes
