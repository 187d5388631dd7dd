"""Rows that every operator must handle: nulls, empty and very long texts, ties,
repeated rows, and further columns whose names operators use themselves."""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, " \
         "key string, part string, n string, grp string, kept string, salt string, seg string"


def texts() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "épée", "straße", "the", "of", "is", "une", "stupid"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(90))
    near = passage.split()
    near[40] = "changed"
    rows: list[tuple] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One two three."), (4, "One two three."),
        (5, "ab " * 9000), (6, passage), (7, passage), (8, " ".join(near)),
        (9, "before " + passage + " after"), (10, "x" * 3000), (11, "日本語のテキスト " * 40),
        (12, "The end of <|endoftext|> it  \u00a0 is\r\n\r\n  so"), (None, passage), (None, None),
        (-3, "a\nb\na\n\nb c d e f g h i j"), (2 ** 62, "last one of the ids"),
    ]
    rows += [(100 + k, " ".join(rng.choice(words) + rng.choice(["", "s", "ing"])
                                for _ in range(rng.randrange(5, 120)))) for k in range(30)]
    return rows


def frame(spark: SparkSession, rows: list[tuple] | None = None, parts: int = 3) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, [None, "en", "de"][k % 3], "s", k, "c", "k", "p", "n", "g", "no", "s", "q")
            for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if rows else df
