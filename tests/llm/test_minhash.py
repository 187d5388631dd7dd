import random

from cases import frame, texts

from tabsense.llm import minhash
from tabsense.llm.components import components
from tabsense.llm.minhash import near_duplicates, one_of_each


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        out.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()))
    return out


def brute(rows, size, percent):
    sets = [(i, s) for i, s in sets_of(rows, size)]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(map(repr, [(i, len(s), None if i is None else find(i),
                              True if i is None else find(i) == i) for i, s in sets]))


def families(n=14, copies=9):
    """Chains of copies with more and more edits: links that no common centre has."""
    rng = random.Random(5)
    rows = []
    for f in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for c in range(copies):
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(60)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((f * 100 + c, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_families_like_brute_force(spark):
    rows = families()
    for size in (2, 5):
        got = near_duplicates(frame(spark, rows), size, 80).collect()
        assert sorted(map(repr, map(tuple, got))) == brute(rows, size, 80)


def one_family(members=400, strays=12):
    """A base with one changed word each, and strays that change a quarter of it; some
    strays are near another stray only."""
    rng = random.Random(17)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for k in range(members + strays):
        words = list(base)
        for _ in range(1 if k < members else 9 + k % 5):
            words[rng.randrange(70)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(words)))
        if k >= members and k % 3 == 0:
            words[rng.randrange(70)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((1000 + k, " ".join(words)))
    return rows


def test_strays_of_a_large_family_in_blocks_and_rounds(spark, monkeypatch):
    rows = families(8) + [(5000 + i, t) for i, t in one_family()]
    expected = brute(rows, 2, 80)
    # whole buckets in one block; many small chunks; first rounds of centres, then blocks
    for chunk, outright in ((4 << 20, 1_000), (4_000, 1_000), (20_000, 0.02)):
        monkeypatch.setattr(minhash, "CHUNK", chunk)
        monkeypatch.setattr(minhash, "OUTRIGHT", outright)
        got = near_duplicates(frame(spark, rows, 3), 2, 80).collect()
        assert sorted(map(repr, map(tuple, got))) == expected


def test_edge_cases(spark):
    got = near_duplicates(frame(spark), 2, 80).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(texts(), 2, 80)
    assert near_duplicates(frame(spark, []), 2, 80).count() == 0
    kept = one_of_each(frame(spark), 5, 80)
    assert kept.columns == frame(spark).columns
    assert kept.filter("doc_id in (6, 7, 8)").count() == 1


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_copy_stays_with_or_without_ids(spark):
    words = [f"w{k}" for k in range(80)]
    text, near = " ".join(words), " ".join([*words[:79], "other"])
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(7, text), (7, text), (None, text), (None, text), (3, near), (None, other), (None, other),
            (9, other + " x"), (5, "short"), (5, "short"), (5, "else"), (None, None), (None, ""), (None, "")]
    for parts in (1, 4):
        got = sorted(((r.doc_id, r.text) for r in one_of_each(frame(spark, rows, parts)).collect()), key=str)
        assert got == sorted([(3, near), (9, other + " x"), (5, "short"), (5, "else"), (None, None),
                              (None, ""), (None, "")], key=str)
    only = [(None, text)] * 300 + [(None, near)] * 200
    assert one_of_each(frame(spark, only)).count() == 1
