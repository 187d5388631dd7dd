import re

from cases import frame, texts

from tabsense.llm.quality import chi2_cdf, chi2_quantile, keep_good, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    n, repeat = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n)


def test_counts_of_edge_cases(spark):
    rows = quality(frame(spark)).collect()
    got = sorted(map(repr, [tuple(r)[:7] for r in rows]))
    assert got == sorted(map(repr, [(i, *counts(t)) for i, t in texts()]))
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality(frame(spark, [])).count() == 0


def test_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in quality(docs).collect()}
    assert got == {r.doc_id: counts(r.text) for r in docs.collect()}


def test_outliers_go_and_ordinary_texts_stay(spark):
    plain = [(k, " ".join(f"{w}{k % 7}" for w in ["some", "ordinary", "words", "of", "text"] * 1)
              + f" number {k} goes here with rest {k * 3}") for k in range(60)]
    odd = [(1000 + k, " ".join(f"w{k}{j}$$$***" for j in range(30))) for k in range(5)]
    rows = [(i, t, "en", "s") for i, t in plain + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r.doc_id: r.kept for r in quality(docs).collect()}
    assert all(verdict[i] for i, _ in plain) and not any(verdict[i] for i, _ in odd)
    assert keep_good(docs).columns == docs.columns
    assert {r.doc_id for r in keep_good(docs).collect()} == {i for i, _ in plain}


def test_labelled_texts(spark):
    """Word tables and texts full of symbols, labelled bad, lie far from their groups'
    own scatter; texts that repeat lines or passages, labelled good, do not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality(docs).filter("not base_failed").join(labels, "doc_id").collect()
    bad = [r.kept for r in rows if not r.quality]
    good = [r.kept for r in rows if r.quality]
    assert len(bad) > 200 and sum(bad) < 0.05 * len(bad)
    assert len(good) > 3000 and sum(good) > 0.99 * len(good)


def test_a_tight_group_and_a_short_text(spark):
    """A group's own scatter decides, and one symbol in a short text does not."""
    plain = [(k, " ".join(f"w{k}{j}" for j in range(100, 300))) for k in range(10, 90)]
    short = [(1, " ".join(f"w1{j}" for j in range(1000, 1010)) + " $")]
    odd = [(1000 + k, " ".join(f"w{k}{j}" + "|" * (j % 10 == 0) for j in range(100, 300)))
           for k in range(10, 13)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in plain + short + odd],
                                 "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality(docs).collect()}
    assert all(got[i] for i, _ in plain + short) and not any(got[i] for i, _ in odd)


def test_chi_square():
    assert abs(chi2_quantile(0.75, 4) - 5.385269) < 1e-5
    assert abs(chi2_cdf(5.385269, 4) - 0.75) < 1e-6
