"""Token ids of whole corpora in binary files of compressed bit or byte planes.

Ids are 32-bit. A file holds the ids of consecutive documents, cut into blocks of a
fixed number of ids. A block is transposed into its 4 byte planes (or 32 bit planes),
each plane is compressed with zstandard by itself, and a plane of zeros takes no byte.
The chunk index says where each block's planes lie, how many ids it holds and their
checksum, so that any range of ids is read by the blocks it touches. Layout
(little-endian):

    head       magic, planes (4 or 32), block size, part, number, ids, documents
    blocks     the planes of each block, one after the other
    index      per block: offset, ids, crc32 of the ids, length of each plane
    documents  null flags, ids and numbers of tokens of the documents, each as a plane
    tail       offset and length of index and documents, magic
    line end   one byte, from Spark's writer

Documents are dealt to tasks by ranges of (doc_id, hash of the text, row number), so
that neither one id nor no id at all makes a task large, and sorted there. A task
encodes them in that order and closes a file at the first document that fills it;
Spark's writer makes one file per row, commits them and leaves no half-written ones.
Files are ordered by the (part, number) in their heads. Where a file's first id stands
in the corpus is a running sum over files within parts, then over parts.

Memory per task: one batch of texts, one file's ids, and the table of words.

Defined cases: a null or empty text is the end id alone; null ids come first and stay
null; rows with one id are ordered by the hash of their text, and equal rows each count;
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, scratch, text_or_empty
from .packing import _byte_letters

MAGIC = b"TSPLANE1"
HEAD = struct.Struct("<8sIIIIQQ")
TAIL = struct.Struct("<QQQQ8s")
BLOCK = 1 << 14       # ids per block
FILE_IDS = 1 << 22    # ids from which a file is closed
CACHE = 600_000
BYTE_PLANES, BIT_PLANES = 4, 32
ROWS = "doc_id long, part long, number long, local long, n_tokens long, ids_crc32 long"


# ---- planes --------------------------------------------------------------

def to_planes(values: np.ndarray, planes: int) -> list[bytes]:
    """The byte planes of an array (as many as its items have bytes), or its bit
    planes; least significant first."""
    flat = values.view(np.uint8).reshape(len(values), values.itemsize).T
    if planes == values.itemsize:
        return [np.ascontiguousarray(p).tobytes() for p in flat]
    bits = np.unpackbits(np.ascontiguousarray(flat)[:, :, None], axis=2, bitorder="little")
    return [np.packbits(bits[k // 8, :, k % 8], bitorder="little").tobytes() for k in range(planes)]


def from_planes(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    """The array whose planes these are."""
    size = np.dtype(kind).itemsize
    if len(parts) == size:
        flat = np.frombuffer(b"".join(parts), np.uint8).reshape(size, n)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
                         for p in parts])
        flat = np.packbits(bits.reshape(size, 8, n), axis=1, bitorder="little")[:, 0]
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def squeezed(planes: list[bytes], level: int = 3) -> list[bytes]:
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(p) if p.strip(b"\0") else b"" for p in planes]


def stretched(data: bytes, lengths: Iterable[int], size: int) -> list[bytes]:
    unpack, at, out = zstandard.ZstdDecompressor(), 0, []
    for n in lengths:
        out.append(unpack.decompress(data[at:at + n]) if n else bytes(size))
        at += n
    return out


# ---- files ---------------------------------------------------------------

def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, part: int, number: int,
               planes: int = BYTE_PLANES, block: int = BLOCK) -> bytes:
    """One file of the documents whose ids (little-endian 32-bit) are ``ids``."""
    every = np.frombuffer(ids, "<u4")
    out = [HEAD.pack(MAGIC, planes, block, part, number, len(every), len(doc_ids))]
    at, index = HEAD.size, []
    for first in range(0, len(every), block):
        some = every[first:first + block]
        packed = squeezed(to_planes(some, planes))
        index.append(struct.pack(f"<QII{planes}I", at, len(some), zlib.crc32(some.tobytes()),
                                 *map(len, packed)))
        out += packed
        at += sum(map(len, packed))
    out += index
    index_size = sum(map(len, index))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    columns = [known, np.array([d or 0 for d in doc_ids], "<i8"), np.array(lengths, "<u8")]
    packed = [squeezed([c.tobytes()]) if c is known else squeezed(to_planes(c, 8)) for c in columns]
    sizes = [len(p) for column in packed for p in column]
    docs = struct.pack("<17I", *sizes) + b"".join(p for column in packed for p in column)
    out += [docs, TAIL.pack(at, index_size, at + index_size, len(docs), MAGIC)]
    return b"".join(out)


class TokenFile:
    """Reader of one file's bytes; blocks are decoded when they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        _, self.planes, self.block, self.part, self.number, self.n_ids, self.n_docs = \
            HEAD.unpack_from(data)
        self.tail_at = len(data) - TAIL.size - (data[-8:] != MAGIC)
        at, size, self.docs_at, docs_size, magic = TAIL.unpack_from(data, self.tail_at)
        if magic != MAGIC or self.docs_at + docs_size != self.tail_at or at + size != self.docs_at:
            raise ValueError("the file of token ids is cut off")
        entry = struct.Struct(f"<QII{self.planes}I")
        self.index = list(entry.iter_unpack(self.data[at:at + size]))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and numbers of tokens of the documents."""
        sizes = struct.unpack_from("<17I", self.data, self.docs_at)
        at = self.docs_at + 4 * len(sizes)
        known = stretched(self.data[at:], sizes[:1], self.n_docs)[0]
        at += sizes[0]
        ids = from_planes(stretched(self.data[at:], sizes[1:9], self.n_docs), self.n_docs, "<i8")
        at += sum(sizes[1:9])
        lengths = from_planes(stretched(self.data[at:], sizes[9:], self.n_docs), self.n_docs, "<u8")
        return [int(i) if k else None for i, k in zip(ids, known, strict=True)], \
            lengths.astype(np.int64)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from place ``first`` up to ``last``; only their blocks are read."""
        last = self.n_ids if last is None else last
        if first >= last:
            return np.zeros(0, "<u4")
        parts = [self._block(k) for k in range(first // self.block, (last - 1) // self.block + 1)]
        at = first % self.block
        return np.concatenate(parts)[at:at + last - first]

    def _block(self, k: int) -> np.ndarray:
        at, n, crc, *lengths = self.index[k]
        size = n if self.planes == BYTE_PLANES else (n + 7) // 8
        out = from_planes(stretched(self.data[at:], lengths, size), n, "<u4")
        if zlib.crc32(out.tobytes()) != crc:
            raise ValueError(f"block {k} of part {self.part}, file {self.number} is damaged")
        return out


# ---- encoding ------------------------------------------------------------

class PieceIds(dict):
    """Match of the tokenizer's pattern -> its ids as little-endian 32-bit bytes."""

    def __init__(self, coder) -> None:
        self.tokenize = coder.model.tokenize
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        # signs of ASCII stand for themselves; white space is no part of a piece
        signs = piece if piece.isascii() and piece.isprintable() \
            else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenize(signs)]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class WordIds(dict):
    """Text without white space -> its ids as little-endian 32-bit bytes.

    The tokenizer drops white space, and neither its normalisation nor its split
    reaches across a space, so a text's ids are those of its words. Most new words are
    known pieces put together: words of printable Latin-1, which its normalisation
    only lower-cases, are split by the file's own pattern, all new ones of a text at
    once, and the library's model is asked for pieces not met before. All other words
    go through the library whole."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        about = json.loads(self.coder.to_str())
        steps = [x["type"] for x in [*about["normalizer"]["normalizers"],
                                     *about["pre_tokenizer"]["pretokenizers"]]]
        split = about["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or not split["invert"] \
                or split["behavior"] != "Removed":
            raise ValueError(f"{path} keeps white space or splits in another way")
        self.special = tuple(t["content"] for t in about["added_tokens"])
        self.pieces = PieceIds(self.coder)
        self.split = regex.compile(split["pattern"]["Regex"] + "| ").findall  # and blanks
        self.plain = regex.compile("[ -~\u00a1-\u00ff]*").fullmatch
        self[""] = b""

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        joined = " ".join(words)
        if not self.plain(joined) or any(s in joined for s in self.special):
            if len(words) > 1:
                return [self.ids_of([w])[0] for w in words]
            return [array("I", self.coder.encode(joined, add_special_tokens=False).ids).tobytes()]
        out, held = [], []
        for piece in self.split(joined.lower()):
            if piece == " ":
                out.append(b"".join(held))
                held = []
            else:
                held.append(self.pieces[piece])
        return [*out, b"".join(held)]

    def encode(self, text: str) -> bytes:
        for c in "\n\r\t":
            text = text.replace(c, " ")
        words = text.split(" ")
        found = list(map(self.get, words))
        if None in found:
            new = list({w: None for w, ids in zip(words, found, strict=True) if ids is None})
            got = dict(zip(new, self.ids_of(new), strict=True))
            found = [got[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            if len(self) + len(new) > CACHE:
                self.clear()
                self[""] = b""
            if len(new) < CACHE:
                self.update((w, ids) for w, ids in got.items() if len(w) <= 64)
        return b"".join(found)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


# ---- Spark ---------------------------------------------------------------

def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2,
                planes: int = BYTE_PLANES, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the files of all
    documents in ascending doc_id order into ``folder``."""
    import public_tokenizers as P

    vocabulary = path or P.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), word_ids(vocabulary)
        number, size = 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal number, size
            data = file_bytes(doc_ids, [len(x) // 4 for x in ids], b"".join(ids), part, number,
                              planes, block)
            doc_ids.clear()
            ids.clear()
            number, size = number + 1, 0
            return pa.record_batch([pa.array([data], pa.binary())], ["file"])

        for b in batches:
            for doc_id, text in zip(b[0], b[1], strict=True):
                doc_ids.append(doc_id.as_py())
                ids.append(coder.encode(text.as_py()) + end)
                size += len(ids[-1]) // 4
                if size >= file_ids:
                    yield close()
        if doc_ids:
            yield close()

    keys = ["doc_id", "hash", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    files = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text") \
        .mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write \
        .option("maxRecordsPerFile", 1).text(folder)


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """The files' bytes (column ``content``). The schema is given, so that the folder
    of an empty table can be read too."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema(T.StructType([
        T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])) \
        .load(folder).filter("length > 1").select("content")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array of long) of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b[0]:
                file, at = TokenFile(content.as_py()), 0
                doc_ids, lengths = file.documents()
                for first in range(0, len(doc_ids), 1000):
                    some = lengths[first:first + 1000]
                    ids = file.ids(at, at + int(some.sum()))
                    cuts = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
                    at += int(some.sum())
                    yield pa.record_batch([
                        pa.array(doc_ids[first:first + 1000], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int64)))],
                        ["doc_id", "ids"])

    return files_in(spark, folder).mapInArrow(run, "doc_id long, ids array<long>")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every
    document, from the files' heads, indexes and blocks alone."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b[0]:
                file = TokenFile(content.as_py())
                doc_ids, lengths = file.documents()
                ends = np.cumsum(lengths)
                if file.n_ids != (ends[-1] if len(ends) else 0):
                    raise ValueError(f"part {file.part}, file {file.number} lacks ids")
                crcs, starts = [], ends - lengths
                for first in range(0, len(doc_ids), 1000):
                    at = int(starts[first])
                    last = min(first + 1000, len(doc_ids))
                    raw = memoryview(file.ids(at, int(ends[last - 1])).tobytes())
                    crcs += [zlib.crc32(raw[4 * (int(starts[k]) - at):4 * (int(ends[k]) - at)])
                             for k in range(first, last)]
                n = len(doc_ids)
                yield pa.record_batch([
                    pa.array(doc_ids, pa.int64()), pa.array(np.full(n, file.part, np.int64)),
                    pa.array(np.full(n, file.number, np.int64)), pa.array(starts),
                    pa.array(lengths), pa.array(crcs, pa.int64())], names)

    docs = cut_lineage(files_in(spark, folder).mapInArrow(run, ROWS))
    files = docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    # a row per part: as many as the writing job had tasks
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    in_part = F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")
    bases = files.select("part", "number", in_part.alias("base")) \
        .join(parts.select("part", before), "part") \
        .select("part", "number", (F.col("base") + F.col("before")).alias("base"))
    return docs.join(bases, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None,
                end_id: int = 2, planes: int = BYTE_PLANES, block: int = BLOCK,
                file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files below ``folder`` and reads them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    write_files(docs, folder, path, end_id, planes, block, file_ids)
    return read_documents(spark, folder)
