"""Bounded-space online packing of tokenized documents into fixed windows.

Each input partition keeps at most ``open_windows`` windows open. A document is
cut into whole windows and a rest; the rest goes into the open window it fits
best. When it fits none and no further window may be opened, the fullest one is
filled up with the head of the rest and emitted. The windows still open at a
partition's end are merged, whole, with those of neighbouring partitions: groups
of ``fan_in`` partitions, so a task merges at most fan_in * open_windows rows of
(window, fill) and never sees tokens.

Memory per task: one batch of texts, the open windows' fills and the tokenizer, which
alone stays with the worker; no table of pieces is kept, as merging a piece anew costs
less than finding it.

Defined cases: a null or empty text is the end id alone; null ids stay null;
repeated rows are packed each; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, releasing, text_or_empty

WINDOW = 1024
OPEN_WINDOWS = 64
FAN_IN = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " \
        "sequence_id long, offset long, part int, is_open boolean"


class Tokens:
    """Encodes whole texts as the ``tokenizers`` file does, to little-endian unsigned
    32-bit ids. Pieces are merged by the equal rank table, which is several times
    faster; texts that hold a special token's string are left to ``tokenizers`` itself,
    which is read when the first of them comes."""

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers as P
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        special = {t["content"]: t["id"] for t in about["added_tokens"]}
        to_byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in about["model"]["vocab"].items()
                 if t not in special}
        self.special = list(special)
        self.fast = tiktoken.Encoding("file", pat_str=P.PATTERN, mergeable_ranks=ranks,
                                      special_tokens=special).encode_to_numpy

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 for itself, the others from U+0100 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    coder = Tokens(path)
    release()  # what reading the file took
    return coder


class Packer:
    """Open windows of one partition: fills by window number."""

    def __init__(self, window: int, most_open: int) -> None:
        self.window, self.most_open, self.count = window, most_open, 0
        self.fill: dict[int, int] = {}

    def _put(self, number: int, length: int) -> tuple[int, int]:
        offset = self.fill.get(number, 0)
        self.fill[number] = offset + length
        if self.fill[number] == self.window:
            del self.fill[number]
        return number, offset

    def _new(self) -> int:
        self.count += 1
        return self.count - 1

    def place(self, total: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset) of a document of ``total`` ids."""
        start = 0
        while start < total:
            left = total - start
            if left >= self.window:
                length, number = self.window, self._new()
            else:
                room = [(f, w) for w, f in self.fill.items() if f + left <= self.window]
                if room:
                    length, number = left, max(room)[1]
                elif len(self.fill) < self.most_open:
                    length, number = left, self._new()
                else:
                    fullest, number = max((f, w) for w, f in self.fill.items())
                    length = self.window - fullest
            yield start, length, *self._put(number, length)
            start += length


def merge_windows(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Best-fit of whole windows, fullest first: sequence_id -> new_id, shift."""
    fills: dict[int, int] = {}
    out = []
    for _, fill, number in sorted((-f, f, w) for w, f in zip(rows["sequence_id"], rows["fill"],
                                                             strict=True)):
        room = [(f, w) for w, f in fills.items() if f + fill <= window]
        target = max(room)[1] if room else number
        out.append((number, target, fills.get(target, 0)))
        fills[target] = fills.get(target, 0) + fill
    return pd.DataFrame(out, columns=["old_id", "new_id", "shift"]).astype("int64")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    import public_tokenizers as P

    file = path or P.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, packer = tokens(file), Packer(window, open_windows)
        for b in batches:
            rows = []
            for doc_id, text in zip(b[0].to_pylist(), b[1], strict=True):
                ids = coder.encode(text.as_py()) + end
                for start, length, number, offset in packer.place(len(ids) // 4):
                    rows.append((doc_id, start, length,
                                 zlib.crc32(ids[4 * start:4 * (start + length)]), len(ids) // 4,
                                 part << 33 | number, offset, part, False))
            yield _batch(rows)
        yield _batch([(None, 0, fill, 0, 0, part << 33 | number, 0, part, True)
                      for number, fill in packer.fill.items()])

    pieces = cut_lineage(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
                         .mapInArrow(releasing(run), PIECE))
    left = pieces.filter("is_open").select(
        "sequence_id", F.col("length").alias("fill"),
        F.floor(F.col("part") / fan_in).alias("neighbours"))
    moved = left.groupBy("neighbours").applyInPandas(
        lambda rows: merge_windows(rows, window), "old_id long, new_id long, shift long")
    return pieces.filter("not is_open").join(moved, F.col("sequence_id") == F.col("old_id"), "left") \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                F.coalesce("new_id", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.bool_()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
