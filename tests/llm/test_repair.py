import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsense.llm import queries, repair

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
         "repaired_sha256"]


def cheapest(rows):
    """Least (cost, audit) by trying every edit in every place, from the end; rows are
    (role, text, must_go, truncated). The shape so far is known by its first and last
    letter."""
    @cache
    def best(i, shape, inserted):
        ways = [(0, "")] if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape) else []

        def follow(letter, cost, i, to, inserted=0):
            longer = shape + to
            if re.fullmatch("s?(ua)*u?", longer):
                found = best(i, longer if len(longer) < 4 else longer[:-2], inserted)
                if found:
                    ways.append((cost + found[0], letter + found[1]))

        if i < len(rows):
            role, _, must_go, truncated = rows[i]
            follow("D", 4, i + 1, "")
            if not must_go:
                late = 3 * truncated
                if role:
                    follow("K", late, i + 1, role[0])
                follow("R", 3 + late, i + 1, "u")
                follow("R", 3 + late, i + 1, "a")
        if inserted < 3:
            follow("I", 3, i, "u", inserted + 1)
            follow("I", 3, i, "a", inserted + 1)
        return min(ways, default=None)

    return best(0, "", 0)


def rebuilt(rows, audit):
    out, i = [], 0
    for letter in audit:
        shape = "".join(r[0] for r, _ in out)
        given_role = "assistant" if shape.endswith("u") else "user"
        if letter == "I":
            out.append((given_role, ""))
            continue
        if letter != "D":
            out.append((rows[i][0] if letter == "K" else given_role, rows[i][1]))
        i += 1
    assert i == len(rows)
    return out


def expected(table):
    """Digest rows by brute force from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, short, seen = [0, 0, 0], [], set()
        for _, role, text in rows:
            ends = re.findall("[^\x20\x09-\x0d]", text)
            fault = 0 if not ends else 1 if (role, text) in seen else 2 if ends[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            short.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = cheapest(short)
        body = "\n".join(f"{r}:{t}" for r, t in rebuilt(short, audit))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select(*NAMES).collect()], key=str)


ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "u", "sys"]),
                          st.integers(1, 3), st.booleans(), st.booleans()), max_size=7)


@settings(max_examples=250, deadline=None)
@given(ROWS)
def test_least_path(rows):
    flat = [(role, "", must_go or k > 0, truncated and not must_go)
            for role, copies, must_go, truncated in rows for k in range(copies)]
    rows = [(r, c, m, t and not m) for r, c, m, t in rows]
    assert repair.whole_conversation(rows) == cheapest(flat)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.lists(st.integers(0, 7), max_size=3))
def test_blocks_join_to_the_least_path(rows, cuts):
    rows = [(r, c, m, t and not m) for r, c, m, t in rows]
    cuts = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    tables = [repair.table_of(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    folded, mids = tables[0][:2], []
    for t in tables[1:]:
        *folded, mid = repair.joined(folded, t[:2])
        mids.append(mid)
    cost, went = repair.last_state(*folded)
    audit = "I" * repair.TO_END[went]
    for t, mid in zip(tables[:0:-1], mids[::-1], strict=True):
        came = mid[went]
        audit, went = t[2][4 * came + went] + audit, came
    audit = tables[0][2][went] + audit
    assert (cost, audit) == repair.whole_conversation(rows)


def edge_rows():
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (None, 3, "user", "Hi."),
            (1, 2 ** 62, "user", "Far!"), (1, -5, "system", "Near."), (1, None, "assistant", "x" * 50_000),
            (2, 1, "user", "Same."), (2, 1, "user", "Same."), (2, 1, "assistant", "Same."), (2, 2, "tool", "T?"),
            (3, 0, "", "no role."), (3, 1, "assistant", " \t\n"), (3, 2, "assistant", " "), (3, 3, "u", "e")]
    rows += [(10 + k, t, ["system", "user", "assistant", "user"][(t * 7 + k) % 4],
              ["One.", "Two", "", "Three?", "One."][(t + k * k) % 5] + f" {t % 3}" * (k % 2))
             for k in range(12) for t in range(k)]
    rows += [(99, t, "user" if t % 2 else "assistant", "Yes." if t % 3 else f"No {t}!") for t in range(14)]
    return rows


@pytest.mark.parametrize("size", [256, 1, 3])
def test_edge_cases(spark, size):
    schema = "conv_id long, turn long, role string, text string, part string, number string, hash string"
    df = spark.createDataFrame([(*r, "p", "n", "h") for r in edge_rows()], schema).repartition(5)
    assert result(repair.repair_digest(df, block_rows=size)) == expected(edge_rows())
    assert repair.repair_digest(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    """It spans tasks and blocks; the sum of its parts is the result of the whole."""
    rows = [(5, t, ["user", "assistant", "assistant", "user", "system"][t * t % 5],
             ["Yes.", f"Text {t}", f"Text {t}!", " "][t % 4]) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    small, large = (result(repair.repair_digest(df, block_rows=n)) for n in (16, 10_000))
    assert small == large and len(small) == 1 and len(small[0][7]) >= 600
    pieces = repair.repair(repair.damaged(repair.rows_of(df)), block_rows=16)
    turns = [r.role for r in repair.repaired_rows(pieces).orderBy("part", "number", "place").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in turns))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
             .select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.QUERIES["op12_conversation_repair"](spark, sf)) == expected(table)
