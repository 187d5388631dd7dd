"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.config import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "documents", "held_out_remainder", "pages", "parts_for",
           "pick", "release", "releasing",
           "scratch", "text_or_empty"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of the input never clash with the
    ones an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts_for(rows: int, per_part: int) -> int:
    """Partitions for a table of so many rows: small tables in steps that repeat
    would otherwise leave one file per shuffle partition each time."""
    return max(8, -(-rows // per_part))


def held_out_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_mod(doc_id, modulus: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def release() -> None:
    """Gives what a task has freed back to the system. A Python worker outlives its
    task, and idle ones count as the executor's memory beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def releasing(run: Callable[[Batches], Batches],
              last: Callable[[], None] = release) -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow`` whose worker calls ``last`` when its task ends."""
    @wraps(run)
    def released(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            last()

    return released
