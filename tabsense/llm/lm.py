"""Language-model scores by deleted interpolation.

A bigram model over words: maximum-likelihood estimates of the bigram, of the
unigram and a uniform one are mixed, with weights per bucket of the context's
frequency (powers of two). The weights are learned by expectation-maximisation
on a held-out fold of the training documents, with the fold's own counts
deleted from all estimates; the scores then use all training counts.

Counts are gathered and brought back by ``exchange``: exact unigram and bigram
counts of the whole training set, keyed by 64-bit hashes. Expectation-
maximisation sees a table of binned likelihood ratios whose size depends on the
bins, not on the corpus.

Defined cases: a null or empty text is the end token alone; null ids count as
the empty id for the split; repeated rows are counted and scored each; an empty
table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_or_empty
from .exchange import Keys, answer_of, ask, buckets_for, make_chunks, thaw

MODULUS, HELD_OUT, FOLD = 7, 2, 3
END = b"\n"  # no word holds white space
BIN = 0.1  # width of a bin of log likelihood ratios
NEVER = -(1 << 20)  # bin of an estimate of zero
UNIGRAM, BIGRAM = 0, 1
ROUNDS = 60


class Chunk:
    """Token numbers of a chunk's documents, end tokens included."""

    def __init__(self, blob: bytes) -> None:
        table = thaw(blob)
        self.ids = table.column(0).to_pylist()
        words: dict[bytes, int] = {END: 0}
        number, tokens, sizes = words.setdefault, [], []
        for text in table.column(1).cast(pa.binary()).to_pylist():
            found = [number(w, len(words)) for w in text.lower().split()]
            tokens += found
            tokens.append(0)
            sizes.append(len(found) + 1)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.tokens = np.array(tokens, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        rest = np.array([crc_mod(i, MODULUS) for i in self.ids], np.int64)
        self.held_out = rest == HELD_OUT
        self.train = np.repeat(rest != HELD_OUT, self.sizes)
        self.fold = np.repeat(rest == FOLD, self.sizes)
        # the context of a document's first token is the end token of another
        self.contexts = np.concatenate([[0], self.tokens[:-1]])
        pairs, self.pair = np.unique(self.contexts * len(words) + self.tokens, return_inverse=True)
        left, right = self.hashes[pairs // len(words)], self.hashes[pairs % len(words)]
        with np.errstate(over="ignore"):
            mixed = left * np.uint64(0x9E3779B97F4A7C15) + right
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            self.pair_hashes = mixed ^ (mixed >> np.uint64(32))

    def keys(self) -> Keys:
        """Counts in training and in the fold by kind, in the order of the keys."""
        out: Keys = {}
        for kind, place, hashes in ((UNIGRAM, self.tokens, self.hashes),
                                    (BIGRAM, self.pair, self.pair_hashes)):
            n = len(hashes)
            values = np.stack([np.bincount(place, self.train, n), np.bincount(place, self.fold, n)],
                              axis=1).astype(np.int64)
            order, found, first = _sorted(hashes)
            out[kind] = (found, np.add.reduceat(values[order], first, axis=0))
        return out

    def totals(self, answers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(train, fold) totals of each token's bigram, context and word."""
        spread = []
        for kind, hashes in ((UNIGRAM, self.hashes), (BIGRAM, self.pair_hashes)):
            _, found, _ = _sorted(hashes)
            spread.append(answer_of(answers, kind, 2)[np.searchsorted(found, hashes)])
        return spread[1][self.pair], spread[0][self.contexts], spread[0][self.tokens]


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    found, first = np.unique(hashes[order], return_index=True)
    return order, found, first


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(frequency))."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _ratio(top: np.ndarray, bottom: np.ndarray | int, uniform: float) -> np.ndarray:
    p = np.divide(top, bottom, out=np.zeros(len(top)), where=np.asarray(bottom) > 0)
    return p / uniform


def learn(table: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Weights (uniform, unigram, bigram) by bucket from rows (bucket, bin of the
    unigram's and of the bigram's ratio to the uniform estimate, tokens). Buckets
    that the fold never reached share the weights learned over all."""
    rows = np.array(table, np.float64).reshape(-1, 4)

    def fit(part: np.ndarray) -> np.ndarray:
        like = np.ones((len(part), 3))
        for k in (1, 2):
            like[:, k] = np.where(part[:, k] == NEVER, 0.0, np.exp(part[:, k] * BIN))
        weights = np.full(3, 1 / 3)
        for _ in range(rounds if len(part) else 0):
            share = like * weights
            share *= (part[:, 3] / share.sum(axis=1))[:, None]
            weights = share.sum(axis=0) / share.sum()
        weights = np.maximum(weights, 1e-6)
        return weights / weights.sum()

    return {-1: fit(rows)} | {int(b): fit(rows[rows[:, 0] == b]) for b in np.unique(rows[:, 0])}


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    def side(doc_id: object) -> int:
        return int(crc_mod(doc_id, MODULUS) == FOLD)

    chunks = make_chunks(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")),
                         side)
    answers, totals = ask(chunks, lambda blob: Chunk(blob).keys(), 2, buckets_for(chunks))
    row = totals.filter(F.col("kind") == UNIGRAM).first()
    n, n_fold, v = (row["s0"], row["s1"], row["n_keys"]) if row else (0, 0, 0)
    uniform = 1 / (v + 1)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, got in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                c = Chunk(blob)
                pair, context, word = (x[:, 0] - x[:, 1] for x in c.totals(got))
                with np.errstate(divide="ignore"):
                    logs = [np.log(_ratio(word, n - n_fold, uniform)),
                            np.log(_ratio(pair, context, uniform))]
                cols = [bucket(context), *[np.where(np.isinf(x), NEVER, np.round(
                    np.where(np.isinf(x), 0, x) / BIN)).astype(np.int64) for x in logs]]
                cells, count = np.unique(np.stack(cols)[:, c.fold], axis=1, return_counts=True)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (*cells, count)],
                                      ["bucket", "one", "two", "n"])

    both = chunks.join(answers, "chunk")
    cells = both.filter("side = 1").select("blob", "answers") \
        .mapInArrow(bins, "bucket long, one long, two long, n long") \
        .groupBy("bucket", "one", "two").agg(F.sum("n")).collect()
    weights = learn([tuple(r) for r in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([weights.get(b, weights[-1]) for b in range(65)])
        for b in batches:
            for blob, got in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                c = Chunk(blob)
                pair, context, word = (x[:, 0] for x in c.totals(got))
                w = table[bucket(context)]
                p = (w[:, 0] + w[:, 1] * _ratio(word, n, uniform)
                     + w[:, 2] * _ratio(pair, context, uniform)) * uniform
                base = np.log10((word + 1) / (n + v + 1))
                yield pa.record_batch(
                    [pa.array(c.ids, pa.int64()), pa.array(c.held_out),
                     pa.array(c.sizes), pa.array(np.add.reduceat(word > 0, c.starts, dtype=np.int64)),
                     pa.array(np.full(len(c.ids), n, np.int64)),
                     pa.array(np.add.reduceat(base, c.starts)),
                     pa.array(np.add.reduceat(np.log10(p), c.starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                     "score"])

    return both.select("blob", "answers").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
