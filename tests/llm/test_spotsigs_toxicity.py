import hashlib
import os
import random
import sys

import numpy as np
import pytest
from cases import frame, texts

from tabsense.llm import spotsigs as S
from tabsense.llm import toxicity as X


def test_edits_follow_the_order_of_ids(spark):
    rows = [r for r in texts() if r[0] is not None]
    for parts in (1, 4, 40):
        got = {}
        for r in S.with_edits(frame(spark, rows, 5), parts).collect():
            got.setdefault(r.doc_id, []).append(r)
        order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
        assert sum(map(len, got.values())) == len(rows)
        for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            t, u = t or "", u or ""
            k = len(t) // 3
            new = t[:len(t) - k] + u[:k]
            want = S.signatures(t.encode()), S.signatures(new.encode()), S.signatures(u.encode())
            assert any((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)
                       == (len(t), hashlib.sha256(new.encode()).hexdigest(), S.write(want[0]), S.write(want[1]))
                       and np.isclose(r.near_edited, S.likeness(want[0], want[1]))
                       and np.isclose(r.near_next, S.likeness(want[0], want[2])) for r in got[i])


def test_null_ids_and_empty_tables(spark):
    got = S.with_edits(frame(spark), 3).collect()
    assert len(got) == len(texts()) and sum(r.doc_id is None for r in got) == 2
    assert S.with_edits(frame(spark, []), 3).count() == 0
    one = S.with_edits(frame(spark, [(5, "only one of the rows")]), 3).first()
    assert one.near_next == 1.0


def test_similarity_join_like_brute_force(spark):
    rng = random.Random(8)
    anchors = ["the", "of", "und", "la"]
    rows = []
    for f in range(12):
        words = [rng.choice(anchors) if k % 3 == 0 else f"w{rng.randrange(900)}" for k in range(rng.randrange(30, 160))]
        for c in range(5):
            rows.append((f * 10 + c, " ".join(w if rng.random() > 0.01 * c else f"x{rng.randrange(99)}"
                                              for w in words)))
    sets = {}
    for _, t in rows:
        s = S.signatures(t.encode())
        sets[hashlib.sha256(s.tobytes()).hexdigest()] = s
    for threshold in (0.8, 0.5):
        got = {frozenset(r) for r in S.near_pairs(frame(spark, rows), threshold).collect()}
        want = {frozenset((a, b)) for a in sets for b in sets if a < b
                and S.likeness(sets[a], sets[b]) >= threshold}
        assert got == want and want


def test_likeness():
    a, b = np.array([1, 2, 3], "<u4"), np.array([2, 3, 4], "<u4")
    assert S.likeness(a, b) == 0.5 and S.alike(a, b, 0.5) and not S.alike(a, b, 0.51)
    assert S.likeness(a[:0], b[:0]) == 1 and S.likeness(a, b[:0]) == 0
    assert (S.read(S.write(a)) == a).all()


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return X.Decoder(X.char_model(X.char_counts(docs)))


def test_restoration(decoder):
    words = X.Words(decoder, lambda w: w)
    for seen, want in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("tr4sh", "trash"),
                       ("stuuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("i-d-i-o-t", "idiot"),
                       ("c l o w n", "clown"), ("p4th3tic!", "pathetic"), ("ordinary", "ordinary")]:
        assert words.of(seen) == [[want]], seen


def test_disguises_of_any_length(decoder):
    words = X.Words(decoder, lambda w: w)
    assert words.of("st" + "u" * 60 + "pid") == [["stupid"]]
    assert words.of("s" + "." * 50 + "tupid") == [["stupid"]]
    phrase = words.of("y0u.are-such_a.$tup1d.person.and-more.of_those.here")
    assert len(phrase) == 1 and {"you", "stupid", "person", "here"} <= set(phrase[0])
    run = words.of(" ".join("stupid" * 12))
    assert len(run) == 1 and run[0].count("stupid") == 12
    assert len(words.of("1d10t.m-r0n" * 3000)) == 1


def test_doubled_letters_and_other_alphabets(decoder):
    words = X.Words(decoder, lambda w: w)
    for seen, want in [("iiddiioott", "idiot"), ("ssttuuppiidd", "stupid"), ("stuupid", "stupid"),
                       ("hello", "hello"), ("идиот-ка", "идиотка"), ("и.д.и.о.т", "идиот"),
                       ("łotr's", "łotrs"), ("日本語!日本", "日本語 日本")]:
        assert words.of(seen)[0][:len(want.split())] == want.split(), seen


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = X.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_edge_cases(spark):
    labels = spark.createDataFrame([(i, 1, int("stupid" in (t or ""))) for i, t in texts()]
                                   + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = X.scored(frame(spark), labels).collect()
    assert len(got) == len(texts())
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert X.scored(frame(spark, []), labels).count() == 0
    none = X.scored(frame(spark), labels.filter("false")).collect()
    assert {r.score for r in none} == {0.0}
    stage = X.not_toxic(frame(spark), labels.withColumn("toxic", (labels.doc_id == 100).cast("int")))
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage.filter("text is null").count() == 2


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_release_gives_freed_memory_back():
    from tabsense.llm.common import release

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    parts = [bytes(2000) for _ in range(60_000)]
    last = parts[-1]  # what lies above the freed ones keeps them from being returned
    del parts
    before = held()
    release()
    assert len(last) == 2000 and held() < before - 50
