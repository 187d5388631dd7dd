import base64
import hashlib
import uuid

import numpy as np
import pytest

from tabsense.llm import warc
from tabsense.llm.urls import RULES, host_links, judge, spread, with_host
from tabsense.llm.warc import pages_to_warc

SCHEMA = "page_id long, url string, html string, sha string, arc string, host string, salt string"
PAGES = [(1, "http://a.com/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "no url", None),
         (4, "http://b.org/\u2028z", ""), (5, "http://c.net/", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"),
         (7, "http://c.net/l", "é" * 70_000), (7, "http://c.net/l", "é" * 70_000), (-8, "u", "z"),
         (None, "http://n.org", "z"), (2 ** 62 + 1, "http://big.org", "<p>one</p>")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def test_pages_round_trip(spark):
    got = pages_to_warc(frame(spark, PAGES).repartition(3), archive_bytes=1000).drop("url").collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        data, f = (h or "").encode(), first.get(h or "")
        revisit = i is not None and f != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if revisit else "response", f if revisit else None))
    # a row without an id is a response: it has no smaller id to be compared with
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pages_to_warc(frame(spark, [])).count() == 0


def test_small_payloads_are_responses(spark):
    got = pages_to_warc(frame(spark, PAGES), least_bytes=5).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 5)


def test_arc_versions():
    docs = [("http://a/", b"HTTP/1.1 200 OK\r\n\r\nbody\nmore\n"), ("http://b c/", b"")]
    for version in (1, 2):
        records = list(warc.arc_records(warc.arc_archive(version, docs)))
        assert [d for _, d in records] == [d for _, d in docs]
        assert [f["URL"] for f, _ in records] == ["http://a/", "http://b%20c/"]
        assert ("Checksum" in records[0][0]) == (version == 2)
    raw = warc.arc_archive(1, []) + b"http://x y/ 1.2.3.4 20200102030405 text/html 3\nabc\n"
    (fields, body), = warc.arc_records(raw)
    assert fields["URL"] == "http://x y/" and body == b"abc"
    record = warc.warc_record(9, fields, b"HTTP/1.1 200 OK\r\n\r\nabc", None) + b"\r\n"
    (named, block), = warc.warc_records(record)
    assert named["WARC-Date"] == "2020-01-02T03:04:05Z" and block.endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.arc_records(raw[:-3]))


def test_record_ids():
    for i in (None, 0, 1, -1, 2 ** 63 - 1, -2 ** 63, 12345678901):
        name = warc.record_id(i)
        assert warc.page_of(name) == i and uuid.UUID(name).version == 8


URLS = ["http://Www.Example.COM/en/x?q", "http://example.com/en/", "http://a.b.net/es/1#t", "ftp://x.net",
        "http://y.net/fr/", "http://yfoonet/fr/", None, "nothing", "http://e.com?x/en/", "://h/p", "",
        "http://com/", "http://xexample.com/en/", "http://İ.org/a"]


def test_rules(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)]
    got = {r.page_id: r for r in judge(frame(spark, rows)).collect()}
    for k, u in enumerate(URLS):
        rest = (u or "").partition("://")[2]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host))
               and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best.name if best else None)
        if best:
            assert got[k].verdict == best.action
    assert judge(frame(spark, [])).count() == 0


def test_links_carry_distrust(spark):
    rows = [(1, "http://bad.net/es/1", None), (2, "http://friend.org/", '<a href="http://bad.net/x">'),
            (3, "http://good.com/", '<A HREF=//fine.org/y>'), (4, "http://fine.org/", "<a href='/z'>"),
            (5, "http://alone.org/", None)]
    verdict = {r.page_id: r.verdict for r in judge(frame(spark, rows)).collect()}
    assert verdict == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    links = {tuple(r) for r in host_links(frame(spark, rows)).collect()}
    assert links == {("friend.org", "bad.net", 1), ("good.com", "fine.org", 1)}


def test_page_rank_like_numpy(spark):
    rng = np.random.default_rng(4)
    n = 12
    w = (rng.random((n, n)) < 0.25) * rng.integers(1, 5, (n, n))
    np.fill_diagonal(w, 0)
    edges = [(f"h{i}", f"h{j}", int(w[i, j])) for i in range(n) for j in range(n) if w[i, j]]
    seed = rng.random(n)
    out = w.sum(axis=1, keepdims=True)
    p = np.divide(w, out, out=np.zeros((n, n)), where=out > 0)
    want = np.linalg.solve(np.eye(n) - 0.85 * p.T, 0.15 * seed)
    got = spread(spark.createDataFrame(edges, "src string, dst string, links long"),
                 spark.createDataFrame([(f"h{i}", "trust", float(seed[i])) for i in range(n)],
                                       "host string, kind string, seed double"))
    ranks = {r.host: r["rank"] for r in got.collect()}
    assert np.allclose([ranks.get(f"h{i}", 0) for i in range(n)], want, rtol=1e-5)


def test_a_chain_is_judged_to_its_end_whatever_else_there_is(spark):
    """60 hosts, each linking to the next; the last is blocked."""
    chain = [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">') for k in range(59)]
    chain += [(59, "http://h59.org/", '<a href="http://bad.net/">'), (60, "http://bad.net/es/", None)]
    other = [(1000 + k, f"http://o{k % 50}.{'com' if k % 2 else 'org'}/", f'<a href="//o{k % 7}.org/">')
             for k in range(3000)]
    for rows in (chain, chain + other):
        got = {r.page_id: r.verdict for r in judge(frame(spark, rows)).collect()}
        assert [got[k] for k in range(61)] == ["block"] * 61
        assert all(v == "allow" for k, v in got.items() if k >= 1000)


def test_hosts(spark):
    got = with_host(spark.createDataFrame([("a://B.c:80/p?q",)], "url string")).first()
    assert (got.host, got.path) == ("b.c:80", "/p")
