from collections import Counter

import corpus_pipeline
from cases import frame, texts

import __spark_entry__
from tabsense.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert names | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near-duplicates"


def test_stages_on_edge_cases(spark):
    docs = frame(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 0


def test_toxicity_stage_decides_as_the_operator(spark):
    from tabsense.llm.toxicity import scored
    docs, labels = frame(spark), spark.read.parquet(f"{SF}/labels.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (real, docs.select(*real.columns)):
        kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.toxicity_stage(spark, d, SF).collect())
        good = Counter(r.doc_id for r in scored(d, labels).filter("predicted = 0").collect())
        assert Counter(i for (i, _), n in kept.items() for _ in range(n)) == good
    assert kept <= Counter(texts())


def test_copies_of_repeated_rows_survive_once(spark):
    """Through the near-duplicate and the suffix stage: with an id, without, and both."""
    body = " ".join(f"word{k}" for k in range(200))
    other = " ".join(f"term{k}" for k in range(200))
    rows = [(7, body), (7, body), (None, other), (None, other), (None, body), (8, "unlike " * 3)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    left = corpus_pipeline.repeat_stage(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == \
        sorted([(7, body), (None, other), (8, "unlike " * 3)], key=str)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
