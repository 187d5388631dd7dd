import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from cases import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsense.llm import divergence as dv
from tabsense.llm import queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least_docs=10, top=10):
    """Brute force over (text, lang, source) rows in whole numbers."""
    groups, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        langs[lang or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = {}
        for name, counts in [(s, c) for (la, s), c in groups.items() if la == lang] + [(None, langs[lang])]:
            total = sum(counts[t] for t in kept)
            share[name] = {t: 1 + 10 ** 9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in [s for s in share if s is not None]:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept))
                     for o in share if o not in (s, None)]
            best = [(t, f(share[s][t], share[None][t])) for t in kept
                    if groups[lang, s][t] and share[s][t] > share[None][t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=700), st.sets(st.integers(0, 5000), max_size=60),
       st.integers(1, 2 ** 40), st.integers(1, 2 ** 40))
def test_merge(a, b, total_a, total_b):
    a, b = (np.array(sorted(x), np.uint64) for x in (a, b))
    assert dv.gallop(b, a).tolist() == np.searchsorted(a, b).tolist()
    n_a, n_b = (np.array([1 + int(i) % 7 for i in x], np.int64) for x in (a, b))
    counts = [dict(zip(x.tolist(), n.tolist(), strict=True)) for x, n in ((a, n_a), (b, n_b))]
    want = 0
    for t in range(5001):
        p, q = (1 + 10 ** 9 * (c.get(t, 0) + 2) // (n + 2 * 9000)
                for c, n in zip(counts, (total_a, total_b), strict=True))
        want += (p - q) ** 2 // (p + q)
    assert dv.merge(a, n_a, b, n_b, total_a, total_b, 9000, 5001) == want
    assert dv.merge(b, n_b, a, n_a, total_b, total_a, 9000, 5001) == want


@given(st.integers(0, 2 ** 50), st.integers(0, 2 ** 51), st.integers(1, 2 ** 49))
def test_shares_are_exact(count, total, kept):
    assert int(dv.shares(count, max(count, total), kept)) == \
        1 + 10 ** 9 * (count + 2) // (max(count, total) + 2 * kept)


def test_edge_cases(spark):
    docs = frame(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least, size in ((1, 50_000), (2, 3), (10, 50_000)):
        assert result(dv.divergence(docs, least, slice_terms=size)) == expected(rows, least)
    assert dv.divergence(frame(spark, [])).count() == 0


def test_ties_null_groups_and_slices(spark):
    rows = [("Éa b c É_é NUL\x00x\u0085y", "x", s) for s in (None, "", "s1", "s2") for _ in range(3)]
    rows += [("b b b " + "q" * k, "x", "s3") for k in range(9)] + [(None, None, "s1"), (None, None, "s2")]
    rows += [("a zz b" * (k % 4), "x", f"s{k % 5}") for k in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    for size in (50_000, 2):
        assert result(dv.divergence(df, 3, 4, size)) == expected(rows, 3, 4)


def test_whole_table_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = queries.ORACLE["op11_divergence"]
    want = sorted(con.execute(f"select lang, source, part, item, value, rank from ({sql})").fetchall())
    assert want
    assert result(queries.QUERIES["op11_divergence"](spark, sf)) == want
    rows = con.execute("select text, lang, source from documents").fetchall()
    assert want == expected(rows)


def test_sums_are_sent_by_bucket_and_added():
    import pyarrow as pa

    rows = [(f"w{k % 7} w{k % 7} v{k} Café", s) for k in range(20) for s in ("a", "b")]
    sent = []
    for some in (rows[:15], rows[15:]):
        sums = dv.Sums()
        for text, source in some:
            sums.add(("en", source), text.encode())
        out = list(sums.rows(4))
        # a row per bucket, not one per source and term
        assert len(out) <= 4 and all(b.num_rows == 1 for b in out)
        sent += out
    got, n, lang = [], defaultdict(Counter), Counter()
    for bucket in range(4):
        parts = [pa.ipc.open_stream(b["sums"][0].as_buffer()).read_all()
                 for b in sent if b["bucket"][0].as_py() == bucket]
        if parts:
            got += dv.added(pa.concat_tables(parts), 4).to_pylist()
    docs = Counter()
    for text, source in rows:
        found = TERM.findall(text.translate(LOWER))
        n[source].update(found)
        lang.update(found)
        docs.update(set(found))
    want = {(s, t): (k, lang[t]) for s in n for t, k in n[s].items() if docs[t] >= 4}
    assert {(r["source"], r["term"]): (r["n"], r["lang_n"]) for r in got} == want
    assert Counter(r["term"] for r in got if r["first"]) == dict.fromkeys({t for _, t in want}, 1)
