"""Byte-level BPE encoding and decoding.

Tokens are found with an Aho-Corasick automaton over the text's bytes mapped to
Latin-1. The encoder takes the longest token at the current position that is
compatible with the token before it, falls back to shorter tokens, and steps
back when none is left; a position once left that way is never entered again, so
the work is linear in the text. Two adjacent tokens are compatible if undoing
their merges shows none that BPE would have made across their border first;
these verdicts are memoised. The result is the one of the merge loop itself.

Text is split by the tokenizer's pattern. As a single space between two
non-space characters always starts a new match, texts are cut there first and
the pieces' encodings are kept in a table of bounded size per worker.

Defined cases: a null or empty text has no ids; repeated rows are encoded alike;
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: entries a worker keeps before it starts afresh
CACHE = 600_000
SPACE = re.compile(r"(?<=\S) (?=\S)")


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ids = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1)
                                    if token[:k] in ranks), -1)
            halves = self._halves(token, i)
            self.parts[i] = halves
            if halves[0] != i:
                self.merged[halves] = i
        self.automaton.make_automaton()

    def _halves(self, token: bytes, limit: int) -> tuple[int, int]:
        """The last merge that makes ``token`` (itself twice for one byte)."""
        parts = [token[k:k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.ids.get(a + b, limit), k)
                      for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, k = min(ranked)
            if rank >= limit:
                return limit, limit
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else (limit, limit)

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 2 * CACHE:
                self.fits.clear()
            known = self.fits[key] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        """Undo merges next to the border, latest first; a pair that merges
        across it before the merge just undone would have come first."""
        before = 1 << 62
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            left_whole, right_whole = self.parts[left][0] == left, self.parts[right][0] == right
            if left_whole and right_whole:
                return True
            # between equals the left merge happens first, so the right one is undone first
            if right_whole or (not left_whole and left > right):
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, size = len(piece), self.size
        longest = [0] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # later ends are longer tokens
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if not closed[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            if token < 0:
                closed[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """One coder per worker, tokenizer file and pattern."""
    import public_tokenizers as P

    return ByteBPE(read_ranks(path or P.path("byte_bpe_50k.tiktoken")), pattern or P.PATTERN)


class Pieces(dict):
    """Text piece -> (ids as decimal text, number of ids, decoded bytes)."""

    def __init__(self, coder: ByteBPE) -> None:
        self.coder = coder

    def __missing__(self, piece: str) -> tuple[str, int, bytes]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.coder.encode(piece)
        found = (" ".join(map(str, ids)), len(ids), self.coder.decode(ids))
        if len(piece) <= 64:
            self[piece] = found
        return found


def cut(text: str) -> list[str]:
    """Pieces whose encodings, joined, are the text's encoding."""
    first, *rest = SPACE.split(text)
    return [first, *[" " + p for p in rest]]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(load(path, pattern))
        for b in batches:
            ids = [[int(i) for p in cut(t) for i in pieces[p][0].split()] for t in b[1].to_pylist()]
            yield pa.record_batch([b[0], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes (binary column ``content``) that its ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for b in batches:
            out = [coder.decode(ids or []) for ids in b[1].to_pylist()]
            yield pa.record_batch([b[0], pa.array(out, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every whole text in one pass; n_tokens, ids_sha256 and
    decoded_sha256 per row."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(load(path, pattern))
        for b in batches:
            counts, ids, texts = [], [], []
            for t in b[1].to_pylist():
                found = [pieces[p] for p in cut(t)]
                counts.append(sum([f[1] for f in found]))
                ids.append(hashlib.sha256(" ".join([f[0] for f in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
            yield pa.record_batch([b[0], pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                   pa.array(texts, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
