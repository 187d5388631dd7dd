"""Counts of 64-bit keys over a whole corpus, brought back to where they occur.

Documents are kept as chunks of bounded size (compressed Arrow rows). Every chunk
sends its distinct keys with local values, sorted and dealt to buckets by their
leading bits; a bucket adds them up and answers each chunk with the totals in
the order of its own keys. A key crosses the network once per chunk, however
often it occurs, so no key is hot; the answer needs no keys at all. Chunks and
their numbers are a checkpointed table: a task that runs again sees the same.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, releasing

CHUNK_BYTES = 6 << 20
#: bytes of compressed chunks for which one bucket is made
BUCKET_BYTES = 4 << 20
#: (distinct sorted uint64 keys, values of shape (n, m)) of a chunk, by kind
Keys = dict[int, tuple[np.ndarray, np.ndarray]]


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def stretch(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def freeze(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return squeeze(sink.getvalue().to_pybytes(), 6)


def thaw(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(stretch(blob)).read_all()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of equal weight side by side."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(stretch(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    """Columns of small non-negative integers, bytes of equal weight together."""
    flat = np.ascontiguousarray(values.T.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return squeeze(np.ascontiguousarray(flat.T).tobytes())


def unpack_values(blob: bytes, columns: int) -> np.ndarray:
    rows = np.frombuffer(stretch(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(rows.T).view("<u8").reshape(columns, -1).T.astype(np.int64)


def make_chunks(docs: DataFrame, side: Callable[[object], int] | None = None,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk long, side int, blob binary) from rows (id, text): as many rows
    of a partition as make ``chunk_bytes`` of text. ``side(id)`` keeps documents of
    different sides in different chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}

        def out(which: int) -> pa.RecordBatch:
            nonlocal count
            table = pa.Table.from_batches(held.pop(which))
            size.pop(which)
            count += 1
            return pa.record_batch([pa.array([part << 32 | count - 1], pa.int64()),
                                    pa.array([which], pa.int32()),
                                    pa.array([freeze(table)], pa.binary())],
                                   ["chunk", "side", "blob"])

        for b in batches:
            # a batch may hold many long texts: at most one chunk's worth at a time
            lengths = np.array([len(x) for x in b[1].cast(pa.binary()).to_pylist()], np.int64)
            cuts = np.cumsum(lengths) // chunk_bytes
            for k in np.unique(cuts):
                part_rows = b.filter(pa.array(cuts == k))
                sides = np.array([side(x) if side else 0 for x in part_rows[0].to_pylist()])
                for which in np.unique(sides):
                    rows = part_rows.filter(pa.array(sides == which))
                    held.setdefault(int(which), []).append(rows)
                    size[int(which)] = size.get(int(which), 0) + rows.nbytes
                    if size[int(which)] >= chunk_bytes:
                        yield out(int(which))
        for which in list(held):
            yield out(which)

    return cut_lineage(docs.mapInArrow(releasing(run), "chunk long, side int, blob binary"))


def buckets_for(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two of buckets, in proportion to the chunks' size."""
    total = chunks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    return 1 << max(3, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))


def ask(chunks: DataFrame, keys: Callable[..., Keys], columns: int, buckets: int,
        extra: str | None = None, largest: tuple[int, ...] = (),
        verdict: Callable[[np.ndarray], np.ndarray] | None = None,
        last: Callable[[], None] = release) -> tuple[DataFrame, DataFrame]:
    """Totals of every key's values over all chunks (of the columns in ``largest``:
    the largest value). ``verdict`` makes of the totals (a row per key) the rows that
    are answered in their place: few small numbers take less room than totals. ``last``
    is called in a worker that has sent its keys.

    ``keys(blob)`` (or ``keys(blob, extra)`` with the named column) gives a chunk's
    keys by kind. Returns answers (chunk, answers: array of (kind, bucket, blob)) and
    sums (kind, n_keys: keys whose first value is positive, s0.. the values' sums)."""
    shift = np.uint64(64 - int(np.log2(buckets)))
    names = ["kind", "bucket", "chunk", "keys", "counts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for kind, (ks, vs) in keys(*row[1:]).items():
                    edges = np.searchsorted(ks >> shift, np.arange(buckets + 1, dtype=np.uint64))
                    rows = [(kind, k, row[0], pack_keys(ks[i:j]), pack_values(vs[i:j]))
                            for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False))
                            if j > i]
                    if rows:
                        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                        yield pa.record_batch([pa.array(c, t) for c, t in
                                               zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_keys(k) for k in rows["keys"]]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
        first = np.flatnonzero(new)
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        values = np.concatenate([unpack_values(v, columns) for v in rows["counts"]])[order]
        sums = np.stack([(np.maximum if c in largest else np.add).reduceat(values[:, c], first)
                         for c in range(columns)], axis=1)
        said = verdict(sums) if verdict else sums
        out, at = [], 0
        for chunk, part in zip(rows["chunk"], parts, strict=True):
            out.append((chunk, pack_values(said[place[at:at + len(part)]])))
            at += len(part)
        total = pd.DataFrame([(-1, None)], columns=["chunk", "blob"])
        got = pd.concat([pd.DataFrame(out, columns=["chunk", "blob"]), total])
        got.insert(0, "bucket", rows["bucket"].iloc[0])
        got.insert(0, "kind", rows["kind"].iloc[0])
        got["n_keys"] = int((sums[:, 0] > 0).sum())
        for c in range(columns):
            got[f"s{c}"] = 0 if c in largest else int(sums[:, c].sum())
        return got

    sums = ", ".join(f"s{c} long" for c in range(columns))
    asked = chunks.select("chunk", "blob", *([extra] if extra else [])).mapInArrow(
        releasing(send, last), "kind int, bucket int, chunk long, keys binary, counts binary")
    got = cut_lineage(asked.groupBy("kind", "bucket").applyInPandas(
        add, f"kind int, bucket int, chunk long, blob binary, n_keys long, {sums}"))
    totals = got.filter("chunk = -1").groupBy("kind").agg(
        F.sum("n_keys").alias("n_keys"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(columns)])
    answers = got.filter("chunk >= 0").groupBy("chunk").agg(
        F.collect_list(F.struct("kind", "bucket", "blob")).alias("answers"))
    return answers, totals


def answer_of(answers: list | None, kind: int, columns: int) -> np.ndarray:
    """The totals of a chunk's keys of one kind, in the keys' order."""
    parts = [a["blob"] for a in sorted(answers or [], key=lambda a: a["bucket"])
             if a["kind"] == kind]
    if not parts:
        return np.zeros((0, columns), np.int64)
    return np.concatenate([unpack_values(p, columns) for p in parts])
