import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, texts

from tabsense.llm import suffix
from tabsense.llm.exchange import freeze, pack_keys, thaw
from tabsense.llm.suffix import dedup, suffix_ranks, without_repeats


def brute(rows, length):
    where = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for d, (_, x) in enumerate(data):
        for k in range(len(x) - length + 1):
            where.setdefault(x[k:k + length], []).append((d, k))
    gone = [np.zeros(len(x) + 1, bool) for _, x in data]
    for places in where.values():
        if len(places) > 1:
            for d, k in places:
                gone[d][k:k + length] = True
    out = []
    for (i, x), g in zip(data, gone, strict=True):
        kept = bytes(b for b, r in zip(x, g, strict=False) if not r)
        out.append((i, len(x), len(x) - len(kept), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(map(repr, [tuple(r)[:5] for r in df.drop("kept").collect()]))


def test_edge_cases(spark):
    rows = [(i, t if t is None else t[:4000]) for i, t in texts()]
    assert got(dedup(frame(spark, rows))) == brute(rows, 400)
    assert dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh "])
def test_overlaps_periods_and_ends(spark, alphabet):
    """Shared passages just below, at and above the length, overlapping each other,
    at either end of a text, within periodic text and next to it."""
    rng = random.Random(len(alphabet))

    def rand(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    shared = [rand(n) for n in (119, 120, 121, 150, 300)] + ["xyz" * 60, rng.choice(alphabet) * 130]
    rows = []
    for k in range(40):
        parts = [rand(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 30)
            parts += [s[cut:] if rng.random() < 0.5 else s, rand(rng.randrange(0, 90))]
        rows.append((k, "".join(parts)))
    assert got(dedup(frame(spark, rows), length=120, window=24)) == brute(rows, 120)


def test_suffix_order(spark):
    rng = random.Random(2)
    strings = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    df = spark.createDataFrame([(0, k, s) for k, s in enumerate(strings)],
                               "chunk long, seg long, s array<bigint>")
    ranks = {r.seg: r.s for r in suffix_ranks(df, 4).collect()}
    suffixes = [(s[i:], ranks[k][i]) for k, s in enumerate(strings) for i in range(len(s))]
    assert [r for _, r in sorted(suffixes)] == sorted(r for _, r in suffixes)
    assert len({r for _, r in suffixes}) == len({tuple(s) for s, _ in suffixes})


def test_suffixes_are_sorted_by_all_phrases_of_their_prefix(spark, monkeypatch):
    """Periodic texts have dense anchors: some prefixes hold more than three phrases, and
    those within shared passages more than nine."""
    rng = random.Random(9)
    shared = ["".join(rng.choices("abcdefgh", k=500)), "abcdefg" * 90, "x" * 700,
              "".join(rng.choices("ab", k=30)) * 25]
    rows = [(k, "".join(rng.choices("abcdefgh", k=60)) + shared[k % 4] + str(k)) for k in range(12)]
    depths, sort = [], suffix.suffix_ranks
    monkeypatch.setattr(suffix, "suffix_ranks",
                        lambda strings, depth, *a: depths.append(depth) or sort(strings, depth, *a))
    assert got(dedup(frame(spark, rows))) == brute(rows, 400)
    p = suffix.Phrases([t.encode() for _, t in rows], 400, 128)
    most = suffix.segments_of(p, 0, np.unique(p.names[p.names > 0]), 400, 128)[1]
    assert most > 27 and depths[0] == 2 and 3 ** max(depths) >= most


def test_stage_keeps_columns_and_whole_characters(spark):
    rows = [(1, "é" * 300 + "a"), (2, "b" + "é" * 300), (3, "short")]
    out = {r.doc_id: r for r in without_repeats(frame(spark, rows)).collect()}
    assert without_repeats(frame(spark, rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert (out[1].text, out[2].text, out[3].text) == ("a", "b", "short") and out[3].n_chars == 5


def test_exact_check_carries_no_names(spark, monkeypatch):
    """Hashes of phrases are as large as the texts; only the search for candidates reads them."""
    seen, every = [], suffix.cut_lineage

    def cut(df):
        seen.append(every(df))
        return seen[-1]

    monkeypatch.setattr(suffix, "cut_lineage", cut)
    rng = random.Random(3)
    passage = " ".join(str(rng.random()) for _ in range(200))
    rows = [(k, f"{k} {passage} {k}") for k in range(6)]
    assert got(dedup(frame(spark, rows))) == brute(rows, 400)
    tables = [df for df in seen if "blob" in df.columns]
    assert len(tables) == 3  # segments, marked ones, with answers
    for df in tables:
        for r in df.collect():
            assert not {"names", "prefix"} & set(thaw(r.blob).column_names)
    assert [df for df in tables if "keys" in df.columns] == tables[:1]
    assert all(dict(df.dtypes)["marks"] == "binary" for df in tables[1:])


def test_answers_carry_no_hashes(spark, monkeypatch):
    """What is around a core is as large as its bytes; only whether it is alike is read."""
    kept, every = [], suffix.cut_lineage
    monkeypatch.setattr(suffix, "cut_lineage", lambda df: kept.append(every(df)) or kept[-1])
    rng = random.Random(5)
    part = "".join(rng.choices("abcdefgh", k=900))
    rows = [(k, "".join(rng.choices("abcdefgh", k=300)) + part[50 * k:50 * k + 600]) for k in range(6)]
    assert got(dedup(frame(spark, rows))) == brute(rows, 400)
    found = [suffix.answer_of(r["answers"], 0, 1)[:, 0] for df in kept if "answers" in df.columns
             for r in df.collect()]
    assert set(np.concatenate(found)) <= {0, suffix.ALIKE, suffix.MIXED}


def test_cores_are_answered_by_a_verdict():
    totals = np.array([[1, 5, suffix.TOP - 5], [2, 5, suffix.TOP - 5], [3, 7, suffix.TOP - 5]])
    assert suffix._surroundings(totals).tolist() == [[0], [suffix.ALIKE], [suffix.MIXED]]
    assert suffix._twice(totals).tolist() == [[0], [1], [1]]


def test_a_worker_drops_its_powers():
    from tabsense.llm.common import releasing

    def run(batches):
        for b in batches:
            suffix._Powers.upto(b)
            yield len(suffix._Powers.up)

    assert next(out := releasing(run, suffix._Powers.drop)(iter([5000, 10]))) >= 5000
    assert list(out) and len(suffix._Powers.up) == 1


def chained(df):
    """Python functions of a plan that read another's rows without an exchange."""
    path, found = [], 0
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = next((k for k, c in enumerate(line) if c.isalpha()), 0)
        path = [x for x in path if x[0] < at]
        above = [name for _, name in path if name not in {"Project", "Filter"}]
        path.append((at, line[at:].split()[0]))
        found += path[-1][1] == "MapInArrow" and above[-1:] == ["MapInArrow"]
    return found


def test_no_stage_holds_two_python_workers_per_core(spark, monkeypatch):
    """Idle workers count beside the next stage's."""
    seen, every = [], suffix.cut_lineage
    monkeypatch.setattr(suffix, "cut_lineage", lambda df: seen.append(chained(df)) or every(df))
    assert chained(without_repeats(frame(spark))) == 0
    assert len(seen) > 5 and not any(seen)


def test_worker_hashes_and_compares_in_small_blocks():
    """A chunk whose phrases and cores all repeat, each core with other surroundings:
    arrays per byte are made for a block, not for the chunk."""
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices("abcdefgh ", k=2000))) for k in range(1000)]
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    blob = freeze(table)
    suffix._Powers.drop()
    tracemalloc.start()
    names = np.unique(suffix._names(blob, 400, 128))
    assert tracemalloc.get_traced_memory()[1] < 50e6
    found = pa.concat_tables([suffix.segments_of(p, at, names, 400, 128)[0]
                              for at, p in suffix._phrases(blob, 400, 128)])
    marks = [k << 32 | i for k, x in enumerate(found.column("prefix").to_pylist())
             for i, y in enumerate(x) if y]
    checked = suffix.Checked(freeze(found.drop_columns(suffix.KEYS)),
                             pack_keys(np.array(marks, np.uint64)), 400, 128)
    tracemalloc.stop()
    every, most, begin = np.arange(len(marks)), 0, []
    for row, start, key in checked.strings(every):
        most = max(most, len(key))
        begin += zip(row.tolist(), start.tolist(), strict=True)
    suffix._Powers.drop()
    assert most <= suffix.BLOCK and len(begin) == 1000 * 1601 == len(set(begin))
    runs = suffix._union(*checked.covered(every))
    assert [x.tolist() for x in runs] == [list(range(1000)), [0] * 1000, [2000] * 1000]


def test_union_of_runs():
    rng = random.Random(8)
    rows = [(rng.randrange(3), b, b + rng.randrange(1, 30)) for b in
            (rng.randrange(300) for _ in range(40))] + [(5, 10, 20), (5, 0, 50), (5, 60, 61), (5, 50, 55)]
    mark = np.zeros((6, 400), bool)
    for r, b, e in rows:
        mark[r, b:e] = True
    want = [(r, int(b), int(e)) for r in range(6) for b, e in
            zip(*[np.flatnonzero(np.diff(np.r_[0, mark[r].astype(int), 0]) == k) for k in (1, -1)], strict=True)]
    got = suffix._union(*[np.array(x, np.int64) for x in zip(*rows, strict=True)])
    assert list(zip(*[x.tolist() for x in got], strict=True)) == want
    assert [len(x) for x in suffix._union(*[np.zeros(0, np.int64)] * 3)] == [0, 0, 0]
