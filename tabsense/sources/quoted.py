"""CSV records whose quoted fields run over line ends, read by many tasks.

Spark splits a text file into byte ranges of whole lines; whether a line starts a
record depends on all the quotes before it. The state at a line's start is one of two,
outside or inside a quoted field, so a range is a map of these two states to two. One
pass finds that map for every range; per file, the maps are chained in the order of the
ranges (a row per range), which gives each range its state. The second pass cuts every
range into records by itself. A record that crosses ranges comes out as fragments, at
most two per range, which are put together per file.

A quote opens a field only where the field starts, two quotes inside are one, and what
follows a closing quote up to the delimiter belongs to the field: the reader's own
rules. Lines end in LF or CRLF.

Memory per task: one Arrow batch, and the longest record.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import cut_lineage

OUTSIDE, INSIDE = 0, 1
WHOLE, HEAD, MIDDLE, TAIL = range(4)   # kinds of rows: records, and fragments by place
_ROWS = "file long, start long, first boolean, kind int, record string"
_NAMES = ["file", "start", "first", "kind", "record"]


class Lines:
    """State of the reader after a line, by the state before it."""

    def __init__(self, sep: str) -> None:
        s = re.escape(sep.encode())
        field = b'(?:"(?:[^"]|"")*+"[^%b]*+|[^"%b][^%b]*+)?+' % (s, s, s)
        self.sep = sep.encode()
        self.closed = re.compile(b"%b(?:%b%b)*+" % (field, s, field), re.DOTALL).fullmatch
        self.quoted = re.compile(b'(?:[^"]|"")*+', re.DOTALL).match

    def after(self, line: bytes, state: int) -> int:
        if b'"' not in line:
            return state
        if state == INSIDE:
            end = self.quoted(line).end()
            if end == len(line):
                return INSIDE
            end = line.find(self.sep, end)
            if end < 0:
                return OUTSIDE
            line = line[end + len(self.sep):]
        return OUTSIDE if self.closed(line) else INSIDE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), start (of the range in it) and the line's bytes."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _without_cr(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


def range_states(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, start and state: how the reader stands at the start of each range."""
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, met = Lines(sep), {}
        for b in batches:
            for file, start, line in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], strict=True):
                now = met.setdefault((file, start), [OUTSIDE, INSIDE])
                line = _without_cr(line.as_py())
                if b'"' in line:
                    now[:] = [rules.after(line, s) for s in now]
        if met:
            rows = [(f, s, *ends) for (f, s), ends in met.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                ["file", "start", "outside", "inside"])

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        state, states = OUTSIDE, []
        for outside, inside in zip(rows["outside"], rows["inside"], strict=True):
            states.append(state)
            state = outside if state == OUTSIDE else inside
        return rows[["file", "start"]].assign(state=states)

    found = _lines(spark, path).mapInArrow(maps, "file long, start long, outside int, inside int")
    return found.groupBy("file").applyInPandas(chained, "file long, start long, state int")


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """first (of its file: the header) and record (its text, without the last line
    end) of every record below ``path``; empty lines are none."""
    # one row per range of a file, some 10**-7 of the data: fit to be broadcast
    states = F.broadcast(cut_lineage(range_states(spark, path, sep)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Lines(sep)
        at, state, parts, came_inside, is_first = None, OUTSIDE, [], False, False
        out: list[tuple] = []

        def close(ended: bool) -> None:
            """The record or fragment read so far."""
            nonlocal parts, came_inside, is_first
            if parts:
                text = b"\n".join(parts)
                kind = (HEAD if came_inside else WHOLE) if ended else MIDDLE if came_inside else TAIL
                if is_first:
                    text = text.removeprefix(b"\xef\xbb\xbf")
                if kind != WHOLE or text:
                    out.append((*at, is_first, kind, text.decode("utf-8", "replace")))
                    is_first = False
            parts, came_inside = [], False

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)

        for b in batches:
            for file, start, line, known in zip(b[0].to_pylist(), b[1].to_pylist(), b[2],
                                                b[3].to_pylist(), strict=True):
                if (file, start) != at:
                    close(ended=False)
                    at, state, came_inside = (file, start), known, known == INSIDE
                    is_first = start == 0
                line = line.as_py()
                bare = _without_cr(line)
                state = rules.after(bare, state)
                parts.append(bare if state == OUTSIDE else line)
                if state == OUTSIDE:
                    close(ended=True)
            yield batch()
        close(ended=False)
        yield batch()

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        """Fragments of one file: a tail, what lies wholly inside, a head."""
        done, first, open_ = [], False, []
        for start, is_first, kind, text in rows.sort_values(["start", "kind"])[_NAMES[1:]] \
                .itertuples(index=False):
            if kind == TAIL:
                open_, first = [text], is_first
                continue
            open_.append(text)
            if kind == HEAD:
                done.append((first, "\n".join(open_)))
                open_, first = [], False
        if open_:
            done.append((first, "\n".join(open_)))   # a quote that is never closed
        return pd.DataFrame(done, columns=["first", "record"])

    rows = _lines(spark, path).join(states, ["file", "start"]).select("file", "start", "line", "state") \
        .mapInArrow(cut, _ROWS)
    crossing = rows.where(F.col("kind") != WHOLE).groupBy("file") \
        .applyInPandas(joined, "first boolean, record string")
    return rows.where(F.col("kind") == WHOLE).select("first", "record").unionByName(crossing)


def read_quoted(spark: SparkSession, path: str, sep: str, columns: int, options: dict) -> DataFrame:
    """The records after each file's header as text columns c0..; ``options`` are
    those of Spark's CSV reader."""
    schema = ", ".join(f"c{k} string" for k in range(columns))
    row = F.from_csv("record", schema, {**options, "sep": sep, "multiLine": "true", "mode": "PERMISSIVE"})
    return records(spark, path, sep).where("not first").select(row.alias("row")).select("row.*")
