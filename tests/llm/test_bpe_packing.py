import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabsense.llm import bpe
from tabsense.llm.packing import Packer, merge_windows, pack


@pytest.fixture(scope="module")
def coder():
    return bpe.load()


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n'sét", max_size=80),
                 st.from_regex(r"( ?[a-z]{1,9}){1,6}", fullmatch=True)))
def test_encodes_like_the_merge_loop(coder, oracle, text):
    ids = oracle.encode_ordinary(text)
    assert coder.encode(text) == ids
    assert [i for p in bpe.cut(text) for i in coder.encode(p)] == ids
    assert coder.decode(ids) == text.encode()


def test_long_pieces(coder, oracle):
    for text in ("a" * 30_000, "abcab" * 4000, "ha" * 9999 + "!" * 5000, "é" * 5000):
        assert coder.encode(text) == oracle.encode_ordinary(text)


def test_round_trip_of_edge_cases(spark, oracle):
    got = sorted(tuple(r) for r in bpe.round_trip(frame(spark)).collect() if r.doc_id is not None)
    want = []
    for i, t in texts():
        ids = oracle.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(w for w in want if w[0] is not None)
    assert bpe.round_trip(frame(spark, [])).count() == 0
    back = bpe.decode(bpe.encode(frame(spark))).collect()
    assert sorted(bytes(r.content) for r in back) == sorted((t or "").encode() for _, t in texts())


def test_packing_keeps_every_id_once(spark):
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in texts():
        want[i].append(slow.encode(t or "", add_special_tokens=False).ids + [0])
    for window, most_open, fan_in in ((1024, 64, 64), (64, 3, 2)):
        rows = pack(frame(spark, parts=5), window=window, open_windows=most_open, fan_in=fan_in).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= window
        for i, docs in want.items():
            pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
            for ids in docs:
                at = 0
                while at < len(ids):
                    p = next(p for p in pieces if p[0] == at and p[3] == len(ids) and p[2]
                             == zlib.crc32(np.array(ids[at:at + p[1]], "<u4").tobytes()))
                    pieces.remove(p)
                    at += p[1]
            assert not pieces
    assert pack(frame(spark, [])).count() == 0


def test_little_padding():
    rng = np.random.default_rng(3)
    packer = Packer(1024, 64)
    total = 0
    for n in rng.lognormal(6, 1.2, 4000).astype(int) + 1:
        total += n
        list(packer.place(int(n)))
        assert len(packer.fill) <= 64
    assert packer.count * 1024 - total < 64 * 1024


def test_merging_of_windows():
    import pandas as pd

    rows = pd.DataFrame({"sequence_id": [1, 2, 3, 4], "fill": [1000, 20, 600, 424]})
    got = merge_windows(rows, 1024).set_index("old_id")
    assert got.loc[2, "new_id"] == 1 and got.loc[2, "shift"] == 1000
    assert got.loc[4, "new_id"] == 3 and got.loc[4, "shift"] == 600


def test_packing_keeps_no_table_of_pieces():
    from tabsense.llm.packing import Tokens

    path = P.path("byte_bpe_50k.json")
    coder, slow = Tokens(path), Tokenizer.from_file(path)
    words = " ".join(f"w{k * k}x" for k in range(2000))
    odd = ["", " a  b\n\n c", words, "x é́  ", "a<|endoftext|> b <|endoftext|>"]
    for k, text in enumerate(odd):
        assert ("slow" in vars(coder)) == (k > 4)  # read when a special token comes
        want = np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.encode(text) == want
    assert not hasattr(coder, "__len__")
