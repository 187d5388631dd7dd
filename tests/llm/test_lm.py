import math
import zlib
from collections import Counter

import numpy as np
from cases import frame, texts

from tabsense.llm.lm import BIN, NEVER, learn, score


def model(rows):
    """The same model by plain counting, weights learned on the same fold."""
    docs = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    rest = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 for i, _ in docs]
    one, two, f1, f2 = Counter(), Counter(), Counter(), Counter()
    for (_, w), r in zip(docs, rest, strict=True):
        pairs = list(zip([b"\n", *w[:-1]], w, strict=True))
        if r != 2:
            one.update(w)
            two.update(pairs)
        if r == 3:
            f1.update(w)
            f2.update(pairs)
    n, v = sum(one.values()), len(one)
    cells = Counter()
    for (_, w), r in zip(docs, rest, strict=True):
        if r == 3:
            for h, x in zip([b"\n", *w[:-1]], w, strict=True):
                c, word, pair = one[h] - f1[h], one[x] - f1[x], two[h, x] - f2[h, x]
                p1 = word / (n - sum(f1.values())) * (v + 1) if word else 0
                p2 = pair / c * (v + 1) if pair else 0
                cells[c.bit_length(), *(round(math.log(p) / BIN) if p else NEVER for p in (p1, p2))] += 1
    weights = learn([(*k, m) for k, m in cells.items()])
    out = []
    for (i, w), r in zip(docs, rest, strict=True):
        s = 0.0
        for h, x in zip([b"\n", *w[:-1]], w, strict=True):
            a, b, c = weights.get(one[h].bit_length(), weights[-1])
            p = a / (v + 1) + b * one[x] / n + (c * two[h, x] / one[h] if one[h] else 0)
            s += math.log10(p)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, r == 2, len(w), sum(one[x] > 0 for x in w), n, base, s))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0], r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_edge_cases_like_plain_counting(spark):
    same(score(frame(spark)).collect(), model(texts()))
    assert score(frame(spark, [])).count() == 0


def test_documents_like_plain_counting_and_better_than_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = score(docs).collect()
    same(got, model([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights():
    rows = [(1, 5, 30, 90), (1, 5, NEVER, 10), (2, NEVER, NEVER, 4)]
    w = learn(rows)
    assert w[1][2] > 0.8 and w[2][0] > 0.99 and all(abs(x.sum() - 1) < 1e-9 for x in w.values())
    assert learn([])[-1].tolist() == [1 / 3] * 3
