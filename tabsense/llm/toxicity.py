"""Toxicity of texts whose spelling may be disguised.

A noisy channel writes letters as look-alike digits and symbols, puts separators
between them, spaces them out or repeats them. Words that show such marks become
a lattice of readings, and Viterbi decoding under a character trigram model picks
the likeliest, at any length. Where marks may also join words (gaps between longer
pieces, runs of single signs) a second reading parts them, and the words of both
count. The model is counted over all texts; other words are taken as they are. Decoded words are kept in a table of bounded size.

The scorer learns from a bounded sample of labelled rows (``SAMPLE``; the rows
with the smallest hashes of their ids): words and word beginnings that occur at
least so often in a document, kept where they tell toxic documents almost purely.
Features are hashes; per task only distinct ones with their counts are sent. A
document's score is the largest probability among its features, or the rate of
toxic documents among those without any.

Defined cases: a null or empty text has the rate of documents without features;
null ids are the empty id for the split and are not in the sample; repeated rows
are scored alike; without labels the score is 0; an empty table gives an empty
result; other columns, the language and source among them, are not read.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, held_out_remainder, release, text_or_empty

MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE = 10_000  # labelled rows at most
FEATURES = 3_000  # candidate features at most
PURE, EVIDENCE, LEAST = (0.97, 0.93, 0.85), 45.0, 6
PREFIXES = range(3, 8)
TIMES = 4  # a feature is "at least 1, 2, .. TIMES occurrences"
CACHE = 400_000

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüßœæåø"
SIZE = len(LETTERS) + 1  # 0: anything else, a border
CODE = np.zeros(0x2000, np.uint8)
CODE[[ord(c) for c in LETTERS]] = np.arange(1, SIZE)
LETTER = {c: k for k, c in enumerate(LETTERS, 1)}
#: fixed values: letters that a sign may stand for
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
         "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e",
         "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou"}
GAP = set(".-_~^'`*,:;/\\")
EDGE = ".,;:?()[]{}\"'|*#%&<>-_~^`"
MARKED = re.compile(r"[0-9@$!|+€(*#%&.\-_~^'`,:;/\\]|(.)\1")
#: a gap beside a piece of several signs: it may be inside a word or join two
SIGN = r"[^\s.\-_~^'`*,:;/\\]"
JOINT = re.compile(rf"(?<={SIGN}{{2}})[.\-_~^'`*,:;/\\](?={SIGN})"
                   rf"|(?<={SIGN})[.\-_~^'`*,:;/\\](?={SIGN}{{2}})")
HAS_LETTER = re.compile(r"[^\W\d_]")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
READ, DROP, KEEP, APART, SAME = log(0.3), log(0.2), log(1e-7), log(0.1), log(0.5)
TWICE, OFTEN = log(0.03), log(0.5)  # a repeated letter of two, of more


# ---- character model -------------------------------------------------------

def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts: SIZE**3 numbers, whatever the
    corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for b in batches:
            for text in b[0].to_pylist():
                c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
                x = np.zeros(len(c) + 3, np.int64)  # borders around the text
                x[2:-1] = CODE[np.minimum(c, len(CODE) - 1)]
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["g", "n"])

    found = docs.select(text_or_empty().alias("text")).mapInArrow(run, "g long, n long") \
        .groupBy("g").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE ** 3)
    for g, n in found:
        counts[g] = n
    return counts.reshape(SIZE, SIZE, SIZE)


def char_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigram, bigram, unigram and uniform estimates mixed."""
    def share(c: np.ndarray) -> np.ndarray:
        total = c.sum(axis=-1, keepdims=True)
        return np.divide(c, total, out=np.zeros_like(c), where=total > 0)

    two = counts.sum(axis=0)
    mixed = 0.9 * share(counts) + 0.08 * share(two)[None] + 0.015 * share(two.sum(axis=0)) \
        + 0.005 / SIZE
    return np.log(mixed).astype(np.float32)


class Decoder:
    """Viterbi decoding of disguised words."""

    def __init__(self, model: np.ndarray, beam: int = 48) -> None:
        self.model, self.beam = model, beam

    def _steps(self, word: str, apart: float) -> list[list[tuple[str, float]]]:
        """For each sign its readings (letters written, log channel probability)."""
        out = []
        looks = LOOKS if any(c in LETTER for c in word) else {}  # of letters in the list
        for k, c in enumerate(word):
            # letters outside the list, and their accents, stand for themselves
            if c in LETTER or unicodedata.category(c)[0] in "LM":
                options = [(c, 0.0)]
                if k and word[k - 1] == c:
                    run = c * 3 in word[max(0, k - 2):k + 2]
                    options.append(("", OFTEN if run else TWICE))
            elif c == " ":
                options = [("", SAME), (" ", apart)]
            else:
                options = [(x, READ) for x in looks.get(c, "")]
                options.append((" ", KEEP))
                if c in GAP:
                    options.append(("", DROP))
            out.append(options)
        return out

    def decode(self, word: str, apart: float = APART) -> str:
        """The likeliest reading of a lower-case word of any length (blanks: words
        apart). A reading is a chain of (reading before, letter), shared as far as
        readings agree: time and memory are linear."""
        model = self.model
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self._steps(word, apart):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, text) in best.items():
                for letters, cost in options:
                    if not letters:
                        state, q, new = (a, b), p + cost, text
                    elif letters == " " and (text is None or text[1] == " "):
                        state, q, new = (a, b), p + cost, text
                    else:
                        c = LETTER.get(letters, 0)
                        state, q, new = (b, c), p + cost + model[a, b, c], (text, letters)
                    if state not in after or q > after[state][0]:
                        after[state] = (q, new)
            if len(after) > self.beam:
                after = dict(sorted(after.items(), key=lambda x: -x[1][0])[:self.beam])
            best = after
        # the end of a word is a border
        ends = [(p + (model[a, b, 0] if b else 0.0), text) for (a, b), (p, text) in best.items()]
        top = max(p for p, _ in ends)
        return max(written(text) for p, text in ends if p == top).strip()


def written(chain: tuple | None) -> str:
    """The letters of a chain (chain before, letter)."""
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


def both(first: list[str], second: list[str]) -> list[str]:
    """The words of two readings; what both hold counts once."""
    return first + list((Counter(second) - Counter(first)).elements())


class Words(dict):
    """Lower-case token -> what ``make`` gives for its restored words."""

    def __init__(self, decoder: Decoder, make) -> None:
        self.decoder, self.make = decoder, make

    def restored(self, token: str) -> list[str]:
        word = token.rstrip(EDGE + "!$+").lstrip(EDGE)
        if not (MARKED.search(word) and HAS_LETTER.search(word)):
            return word.split()
        found = self.decoder.decode(word).split()
        pieces = JOINT.split(word)
        if len(pieces) == 1:
            return found
        return both(found, [w for p in pieces for w in (
            self.decoder.decode(p).split() if HAS_LETTER.search(p) else [p])])

    def spelled(self, run: str) -> list[str]:
        """Words of a run of single signs, whose blanks do not tell where words end:
        read as few words, and as the character model alone would part them."""
        if not HAS_LETTER.search(run):
            return [run]
        return both(self.decoder.decode(run).split(), self.decoder.decode(run, SAME).split())

    def __missing__(self, token: str):
        if len(self) >= CACHE:
            self.clear()
        found = self.make(self.restored(token))
        if len(token) <= 64:
            self[token] = found
        return found

    def of(self, text: str) -> list:
        """One value per token of a text; runs of single signs are one token."""
        text = text.lower()
        if SPACED.search(text) is None:
            return [self[w] for w in text.split()]
        out, at = [], 0
        for run in SPACED.finditer(text):
            out += [self[w] for w in text[at:run.start()].split()]
            out.append(self.make(self.spelled(" ".join(run[0].split()))))
            at = run.end()
        return out + [self[w] for w in text[at:].split()]


# ---- features and scorer ---------------------------------------------------

def word_features(words: list[str]) -> np.ndarray:
    """Hashes of words and word beginnings; the low bits are left for the times."""
    found = []
    for w in words:
        w = w.strip(EDGE + "!$")
        if w:
            found.append(w + " ")
            found += [w[:k] for k in PREFIXES if k <= len(w)]
    return np.array([xxhash.xxh3_64_intdigest(x) >> 4 << 3 for x in found], np.int64)


def text_features(words: Words, text: str) -> np.ndarray:
    """Distinct features of a text: hash + j for at least j + 1 occurrences."""
    parts = words.of(text)
    if not parts:
        return np.zeros(0, np.int64)
    found, count = np.unique(np.concatenate(parts), return_counts=True)
    return np.concatenate([found[count > j] + j for j in range(TIMES)])


def choose(rows: list[tuple[int, list[int]]]) -> tuple[dict[int, float], float]:
    """Features that tell toxic documents almost purely, with their probability,
    and the rate among documents without any. The purest come first; documents that
    they cover no longer speak for less pure ones (a beginning that a toxic word
    shares with harmless ones)."""
    chosen: dict[int, float] = {}
    left = [(y, set(f)) for y, f in rows]
    levels = list(PURE)
    while True:
        n, toxic = len(left), sum(y for y, _ in left)
        rate = toxic / n if n else 0.0
        seen, hit = Counter(), Counter()
        for y, f in left:
            seen.update(f)
            if y:
                hit.update(f)
        pure = {f: (k + 2 * rate) / (seen[f] + 2) for f, k in hit.items()
                if k >= LEAST and (k + 2 * rate) / (seen[f] + 2) >= levels[0]
                and evidence(seen[f], k, n, toxic) >= EVIDENCE}
        if not pure:
            if len(levels) == 1:
                return chosen, rate
            levels.pop(0)
            continue
        chosen |= pure
        left = [(y, f) for y, f in left if not f & pure.keys()]


def evidence(n: int, k: int, total: int, toxic: int) -> float:
    """Likelihood-ratio statistic G2 of a feature in n documents, k of them toxic."""
    p = toxic / total
    cells = ((k, n * p), (n - k, n * (1 - p)), (toxic - k, (total - n) * p),
             (total - n - toxic + k, (total - n) * (1 - p)))
    return 2 * sum(o * log(o / e) for o, e in cells if o and e)


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE,
          features: int = FEATURES) -> tuple[dict[int, float], float]:
    """Chosen features and rest rate from at most ``sample`` labelled rows."""
    ids = F.col("doc_id").cast("long")
    taken = labels.select(ids.alias("doc_id"), F.col("toxic").cast("int").alias("y")) \
        .filter((held_out_remainder(F.col("doc_id"), MODULUS) != HELD_OUT)
                & F.col("doc_id").isNotNull() & F.col("y").isNotNull()) \
        .groupBy("doc_id").agg(F.max("y").alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers: small enough to send everywhere
    rows = docs.select(ids.alias("doc_id"), text_or_empty().alias("text")) \
        .join(F.broadcast(taken), "doc_id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Decoder(model), word_features)
        for b in batches:
            ys = np.array(b[0].to_pylist(), np.int64)
            parts = [text_features(words, t) for t in b[1].to_pylist()]
            if parts:
                found, place = np.unique(np.concatenate(parts), return_inverse=True)
                y = np.repeat(ys, [len(p) for p in parts])
                yield pa.record_batch(
                    [pa.array(found), pa.array(np.bincount(place).astype(np.int64)),
                     pa.array(np.bincount(place, y).astype(np.int64))], ["f", "n", "k"])

    total, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not total or not toxic:
        return {}, 0.0
    counts = rows.mapInArrow(count, "f long, n long, k long").groupBy("f") \
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k")).filter(F.col("k") >= LEAST)
    rate = F.lit(toxic / total)

    def cell(o, e):
        return F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)

    n, k, rest = F.col("n"), F.col("k"), F.lit(total) - F.col("n")
    g = cell(k, n * rate) + cell(n - k, n * (1 - rate)) + cell(F.lit(toxic) - k, rest * rate) \
        + cell(rest - F.lit(toxic) + k, rest * (1 - rate))
    wanted = sorted(r["f"] for r in counts.filter(k / n > 0.5).orderBy(F.desc(g), "f")
                    .limit(features).select("f").collect())
    known = np.array(wanted, np.int64)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Decoder(model), word_features)
        for b in batches:
            found = [np.intersect1d(text_features(words, t), known) for t in b[1].to_pylist()]
            yield pa.record_batch([b[0], pa.array(found, pa.list_(pa.int64()))], ["y", "f"])

    return choose([(r["y"], r["f"]) for r in rows.mapInArrow(hits, "y int, f array<bigint>")
                   .collect()])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
           carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, and the columns named in
    ``carry``."""
    model = char_model(char_counts(docs))
    chosen, rest = learn(docs, labels, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE**3 numbers

    def wanted(words: list[str]) -> tuple[int, ...]:
        return tuple(int(f) for f in word_features(words) if int(f) in bases)

    bases = {f >> 3 << 3 for f in chosen}

    def score(parts: list[tuple[int, ...]]) -> float:
        best = rest
        for f, n in Counter([f for p in parts for f in p]).items():
            for j in range(min(n, TIMES)):
                best = max(best, chosen.get(f + j, 0.0))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Decoder(sent.value), wanted)
        for b in batches:
            scores = [score(words.of(t)) for t in b[1].to_pylist()]
            yield pa.record_batch(
                [b[0], pa.array([crc_mod(i, MODULUS) == HELD_OUT for i in b[0].to_pylist()],
                                pa.bool_()), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32()), *b.columns[2:]],
                ["doc_id", "held_out", "score", "predicted", *carry])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"),
                       *[F.col(f"`{c}`") for c in carry])
    fields = "".join(f", `{c}` {t}" for c, t in rows.select(*carry).dtypes) if carry else ""
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + fields)


class Scorer:
    """Scores of texts in one worker; the character model arrives by broadcast."""

    def __init__(self, sent, chosen: dict[int, float], rest: float) -> None:
        self.chosen, self.rest = chosen, rest
        bases = {f >> 3 << 3 for f in chosen}
        self.words = Words(Decoder(sent.value), lambda words: tuple(
            int(f) for f in word_features(words) if int(f) in bases))

    def of(self, text: str) -> float:
        best = self.rest
        for f, n in Counter([f for p in self.words.of(text) for f in p]).items():
            for j in range(min(n, TIMES)):
                best = max(best, self.chosen.get(f + j, 0.0))
        return best


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic (columns doc_id, text, lang,
    source, n_chars). A null text stays null. Texts go to Python once and only the
    scores come back."""
    model = char_model(char_counts(docs))
    chosen, rest = learn(docs, labels, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE**3 numbers

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent, chosen, rest)
        try:
            for texts in batches:
                # one text at a time: a batch never stands beside its copy
                yield pa.array([scorer.of(t.as_py()) for t in texts], pa.float64())
        finally:
            scorer.words.clear()
            release()

    return docs.select("doc_id", "text", "lang", "source", "n_chars") \
        .filter(toxicity(text_or_empty()) < threshold)
