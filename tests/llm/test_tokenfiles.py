import zlib

import numpy as np
import public_tokenizers as P
import pytest
from cases import frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabsense.llm import tokenfiles as tf


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2 ** 63, 2 ** 63 - 1)),
                          st.lists(st.integers(0, 2 ** 32 - 1), max_size=40)), max_size=12),
       st.sampled_from([tf.BYTE_PLANES, tf.BIT_PLANES]), st.integers(1, 50))
def test_file_round_trip(docs, planes, block):
    ids = np.array([i for _, d in docs for i in d], "<u4")
    data = tf.file_bytes([d for d, _ in docs], [len(d) for _, d in docs], ids.tobytes(), 3, 1,
                         planes, block)
    for stored in (data, data + b"\n"):
        file = tf.TokenFile(stored)
        assert (file.part, file.number, file.n_ids, file.n_docs) == (3, 1, len(ids), len(docs))
        got, lengths = file.documents()
        assert got == [d for d, _ in docs] and lengths.tolist() == [len(d) for _, d in docs]
        assert file.ids().tolist() == ids.tolist()
        third = len(ids) // 3
        assert file.ids(third, 2 * third).tolist() == ids[third:2 * third].tolist()


def test_damage_is_found():
    ids = np.arange(40_000, dtype="<u4")
    data = tf.file_bytes([1], [len(ids)], ids.tobytes(), 0, 0)
    file = tf.TokenFile(data)
    assert len(file.index) == 3 and tf.TokenFile(data).ids(20_000, 20_003).tolist() == [20_000, 20_001, 20_002]
    # the planes of high bytes hold zeros only and take no room
    assert file.index[0][5:] == (0, 0)
    with pytest.raises(ValueError):
        tf.TokenFile(data[:-30])
    at = file.index[1][0] + file.index[1][3] // 2
    broken = data[:at] + bytes([data[at] ^ 255]) + data[at + 1:]
    with pytest.raises(Exception):
        tf.TokenFile(broken).ids()
    assert tf.TokenFile(broken).ids(0, 100).tolist() == list(range(100))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aB \n\t'sÉ́Σς<|>1.,-", max_size=60),
                 st.text([chr(k) for k in range(1, 256)], max_size=60),
                 st.from_regex(r"( ?(<\|endoftext\|>|[A-Za-z']{1,9}|[0-9.!]{1,4})\s?){1,6}",
                               fullmatch=True)))
def test_words_have_the_ids_of_the_text(coder, text):
    ids = np.frombuffer(tf.word_ids(P.path("word_bpe_49k.json")).encode(text), "<u4").tolist()
    assert ids == coder.encode(text, add_special_tokens=False).ids


def test_new_words_of_a_text_are_split_at_once(coder):
    """Known ones not at all; words that the pattern alone cannot split go by themselves."""
    words, calls = tf.WordIds(P.path("word_bpe_49k.json")), []
    split = words.split
    words.split = lambda x: calls.append(x) or split(x)
    first = " ".join(f"word{k}'s, Ünd{k % 7}--" for k in range(200))
    for text, times in ((first, 1), (first, 0), ("one  word0's,\n ÜND1-- two one ", 1),
                        ("x<|endoftext|>y three e\u0301tude \x85 four", 2), ("", 0), ("  ", 0)):
        calls.clear()
        got = np.frombuffer(words.encode(text), "<u4").tolist()
        assert got == coder.encode(text, add_special_tokens=False).ids and len(calls) == times


def test_words_kept_are_bounded(coder, monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 20)
    words = tf.WordIds(P.path("word_bpe_49k.json"))
    for k in range(0, 90, 7):
        text = " ".join(f"w{j}" for j in range(k, 2 * k + 3)) + " w1 w1"
        assert np.frombuffer(words.encode(text), "<u4").tolist() == \
            coder.encode(text, add_special_tokens=False).ids
        assert len(words) <= 21 and len(words.pieces) <= 20


def expected(coder, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("options", [{}, {"planes": tf.BIT_PLANES, "block": 100, "file_ids": 500}])
def test_files_of_edge_cases(spark, coder, options):
    got = [tuple(r) for r in tf.token_files(frame(spark, parts=4), **options)
           .select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    got.sort(key=lambda r: r[1])
    # ids ascend, nulls first; starts leave no gap
    assert [r[0] for r in got] == sorted([i for i, _ in texts()], key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    want = expected(coder, texts())
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    assert tf.token_files(frame(spark, []), **options).count() == 0


def test_unique_ids_and_read_back(spark, coder, tmp_path):
    rows = [(1000 - 7 * k, f"Text {k}: " + "word's end. " * (k % 9)) for k in range(120)]
    folder = str(tmp_path / "files")
    got = sorted(tuple(r) for r in tf.token_files(frame(spark, rows), folder=folder, file_ids=300).collect())
    assert got == expected(coder, sorted(rows))
    back = {r.doc_id: r.ids for r in tf.read_ids(spark, folder).collect()}
    assert back == {i: coder.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    assert len(list((tmp_path / "files").glob("part-*"))) > 8
