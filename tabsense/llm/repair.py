"""Repair of conversations: the cheapest edits that make the speakers alternate.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Rows can be
kept, given the role user or assistant, or deleted, and empty rows of either inserted;
of the cheapest ways the one whose edits' initials (D, I, K, R) are ASCII-least counts.
A path through the graph of (rows read, state of the pattern) weighs one integer: its
high digits are the cost, below them stand as many base-8 digits as the longest audit
may have, one per letter from the left, zeros after its end. The least integer at each
node is all that the search keeps.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any
size is spread over tasks. A task cuts a conversation into blocks of bounded size and
finds the least path of a block for each state it may start and end in (only from the
start, if the conversation lies wholly inside the task). Paths of one block that start
alike are no prefixes of each other, so their order alone, not their letters, decides
between whole conversations: blocks are joined as 4 x 4 tables of (cost, rank), first
within a task, then over the tasks that share a conversation (a row each), and the
chosen states go back the same way. No step holds a long conversation; equal rows of a
turn are counted before they meet. Only the digest, one hash over a whole conversation
and one audit string, streams its repaired blocks through one task, in order.

Defined cases: a null role or text is one space; null turns come first; rows of one
turn are ordered by role, first 64 characters and hash of the text; a null
conv_id is a conversation of its own; a role without a letter in ``sua`` can't be kept;
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 22
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3      # costs
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
DIGITS = str.maketrans("1234", "DIKR")
#: states of the pattern: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
        (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the role that may be given or inserted, and the inserts that end a conversation
TURN_OF = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
NONE = -1

ROW = "conv long, lost boolean, turn long, role string, text string, copies long, " \
      "blank boolean, first boolean, truncated boolean"
BLOCKS = "conv long, lost boolean, part long, number long, whole boolean, faults array<long>, " \
         "mids array<long>, prefix array<long>, marks array<string>, audits array<string>, " \
         "roles array<string>, texts array<string>, copies array<long>"
PIECES = "conv_id long, part long, number long, whole boolean, faults array<long>, audit string, " \
         "repaired array<struct<role: string, text: string>>"


# ---- least paths ---------------------------------------------------------

def least_paths(rows: list[tuple], starts: tuple[int, ...]) -> dict[int, dict[int, tuple[int, int, int]]]:
    """For each start, by end state: (least integer, letters in it, digits' width). Rows
    are (role, copies, must_go, truncated); of several copies all but the first go."""
    width = sum(c + 2 for _, c, _, _ in rows) + 2
    # edges into a row: up to two inserts, more would only come back to a state
    out = {}
    for start in starts:
        now = {start: (0, 0)}
        for role, copies, must_go, truncated in rows:
            then: dict[int, tuple[int, int]] = {}

            def reach(state: int, value: int, at: int, letters: int, count: int, cost: int) -> None:
                """Adds ``count`` letters (base-8 digits) at place ``at``."""
                value += (cost << 3 * width) + (letters << 3 * (width - at - count))
                if state not in then or value < then[state][0]:  # noqa: B023
                    then[state] = (value, at + count)  # noqa: B023

            rest = copies - 1
            gone = ((1 << 3 * rest) - 1) // 7  # the copies' letters D: ones throughout
            for state, (value, at) in now.items():
                for inserts in range(3):
                    before = (0, 2, 18)[inserts]  # I, II
                    price = INSERT * inserts + DELETE * rest
                    edits = [("D", DELETE, state)]
                    if not must_go:
                        late = TRUNCATED if truncated else 0
                        kept = NEXT.get((state, role[:1]))
                        edits.append(("R", RELABEL + late, NEXT[state, TURN_OF[state][0]]))
                        if kept is not None:
                            edits.append(("K", late, kept))
                    for letter, cost, to in edits:
                        digits = (before << 3 | LETTERS[letter]) << 3 * rest | gone
                        reach(to, value, at, digits, inserts + 1 + rest, price + cost)
                    state = NEXT[state, TURN_OF[state][0]]
            now = then
        out[start] = {s: (v, n, width) for s, (v, n) in now.items()}
    return out


def audit_of(value: int, letters: int, width: int) -> str:
    digits = (value & (1 << 3 * width) - 1) >> 3 * (width - letters)
    return format(digits, "o").translate(DIGITS) if letters else ""


def whole_conversation(rows: list[tuple]) -> tuple[int, str]:
    """(cost, audit) of a conversation's least path."""
    ends = []
    for state, (value, at, width) in least_paths(rows, (START,))[START].items():
        more = TO_END[state]
        ends.append((value + (INSERT * more << 3 * width)
                     + ((0, 2, 18)[more] << 3 * (width - at - more)), at + more, width))
    value, at, width = min(ends)
    return value >> 3 * width, audit_of(value, at, width)


def table_of(rows: list[tuple]) -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks (among paths of one start, by audit) and audits of a block by
    4 * start + end; cost NONE where there is no path."""
    costs, ranks, audits = [NONE] * 16, [NONE] * 16, [""] * 16
    for start, ends in least_paths(rows, tuple(STATES)).items():
        for end, (value, at, width) in ends.items():
            costs[4 * start + end] = value >> 3 * width
            audits[4 * start + end] = audit_of(value, at, width)
        for rank, end in enumerate(sorted(ends, key=lambda e: audits[4 * start + e])):  # noqa: B023
            ranks[4 * start + end] = rank
    return costs, ranks, audits


def joined(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]
           ) -> tuple[list[int], list[int], list[int]]:
    """Costs and ranks of two neighbours together, and the state between them."""
    costs, ranks, mids = [NONE] * 16, [NONE] * 16, [NONE] * 16
    for start in STATES:
        order = []
        for end in STATES:
            ways = [((a[0][4 * start + m] + b[0][4 * m + end]) * 16
                     + a[1][4 * start + m] * 4 + b[1][4 * m + end], m) for m in STATES
                    if a[0][4 * start + m] != NONE and b[0][4 * m + end] != NONE]
            if ways:
                value, mids[4 * start + end] = min(ways)
                costs[4 * start + end] = value // 16
                order.append((value % 16, end))
        for rank, (_, end) in enumerate(sorted(order)):
            ranks[4 * start + end] = rank
    return costs, ranks, mids


def last_state(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """(cost, end state) of the least path from the start to an end."""
    cost, _, end = min((costs[e] + INSERT * TO_END[e], ranks[e], e) for e in STATES if costs[e] != NONE)
    return cost, end


def replay(audit: str, state: int, roles: list[str], texts: list[str],
           copies: list[int]) -> tuple[list[tuple[str, str]], int]:
    """The rows that an audit leaves, and the state after them."""
    out, at = [], 0

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            out.append((TURN_OF[state], ""))
            state, at = NEXT[state, TURN_OF[state][0]], at + 1

    for role, text, n in zip(roles, texts, copies, strict=True):
        inserts()
        if audit[at] != "D":
            role = role if audit[at] == "K" else TURN_OF[state]
            out.append((role, text))
            state = NEXT[state, role[0]]
        at += n
    inserts()
    return out, state


# ---- faults --------------------------------------------------------------

class Counts:
    """Faults of consecutive rows, with what is needed to join them to their
    neighbours: first and last initial, first and last turn."""

    __slots__ = ("blank", "duplicate", "truncated", "illegal", "rows", "turns", "first_turn",
                 "last_turn", "head", "tail")

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.turns = 0
        self.first_turn = self.last_turn = 0
        self.head = self.tail = ""

    def add(self, row: tuple) -> None:
        _, _, turn, role, _, copies, blank, first, truncated = row
        if not copies:
            return
        one = Counts()
        one.rows, one.head, one.tail = copies, role[:1], role[:1]
        one.illegal = copies - 1
        if blank:
            one.blank = copies
        else:
            one.duplicate = copies - bool(first)
            one.truncated = int(first and truncated)
        if turn is not None:
            one.turns, one.first_turn, one.last_turn = 1, turn, turn
        self.join(one)

    def join(self, then: Counts) -> None:
        if self.rows and then.rows:
            self.illegal += self.tail + then.head not in LEGAL
        if self.turns and then.turns:
            self.turns -= self.last_turn == then.first_turn
        if then.rows:
            self.head, self.tail = self.head if self.rows else then.head, then.tail
        if then.turns:
            self.first_turn = self.first_turn if self.turns else then.first_turn
            self.last_turn = then.last_turn
        for name in ("blank", "duplicate", "truncated", "illegal", "rows", "turns"):
            setattr(self, name, getattr(self, name) + getattr(then, name))

    def faults(self, cost: int) -> list[int]:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost]

    def numbers(self) -> list[int]:
        return [getattr(self, n) for n in self.__slots__[:8]]

    @classmethod
    def of(cls, numbers: list[int], marks: list[str]) -> Counts:
        out = cls()
        for name, value in zip(cls.__slots__, [*numbers, *marks], strict=True):
            setattr(out, name, value)
        return out


# ---- blocks --------------------------------------------------------------

class Blocks:
    """Cuts the sorted rows of a task into blocks. The first and the last conversation
    of a task may go on in its neighbours; those, and any longer than a block, are
    joined later."""

    def __init__(self, part: int, block_rows: int, block_bytes: int) -> None:
        self.part, self.block_rows, self.block_bytes = part, block_rows, block_bytes
        self.key: tuple | None = None
        self.rows: list[tuple] = []
        self.bytes = self.number = 0
        self.folded: tuple[list[int], list[int]] | None = None
        self.counts = Counts()
        self.inner = False  # whether the conversation began inside this task

    def add(self, row: tuple) -> Iterator[tuple]:
        if row[:2] != self.key:
            if self.key is not None:
                yield self._close(ends=True, inside=self.inner)
            self.inner, self.key = self.key is not None, row[:2]
            self.number, self.folded, self.counts = 0, None, Counts()
        elif len(self.rows) >= self.block_rows or self.bytes >= self.block_bytes:
            yield self._close(ends=False, inside=False)
        self.rows.append(row)
        self.bytes += len(row[3]) + len(row[4])
        self.counts.add(row)

    def end(self) -> Iterator[tuple]:
        if self.key is not None:
            yield self._close(ends=True, inside=False)

    def _close(self, ends: bool, inside: bool) -> tuple:
        rows = [r for r in self.rows if r[5]]
        short = [(role, n, blank or not first, truncated)
                 for _, _, _, role, _, n, blank, first, truncated in rows]
        whole = inside and self.number == 0
        faults = mids = prefix = marks = None
        if whole:
            cost, audit = whole_conversation(short)
            faults, audits = self.counts.faults(cost), [audit]
        else:
            costs, ranks, audits = table_of(short)
            if self.folded is None:
                mids = [k // 4 if costs[k] != NONE else NONE for k in range(16)]
                self.folded = costs, ranks
            else:
                costs, ranks, mids = joined(self.folded, (costs, ranks))
                self.folded = costs, ranks
            if ends:
                prefix = [*costs, *ranks, *self.counts.numbers()]
                marks = [self.counts.head, self.counts.tail]
        out = (*self.key, self.part, self.number, whole, faults, mids, prefix, marks, audits,
               *[[r[k] for r in rows] for k in (3, 4, 5)])
        self.number, self.rows, self.bytes = self.number + 1, [], 0
        return out


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())
_ID = [("conv", pa.int64()), ("lost", pa.bool_()), ("part", pa.int64())]
BLOCK_SCHEMA = pa.schema([*_ID, ("number", pa.int64()), ("whole", pa.bool_()), ("faults", _LONGS),
                          ("mids", _LONGS), ("prefix", _LONGS), ("marks", _TEXTS), ("audits", _TEXTS),
                          ("roles", _TEXTS), ("texts", _TEXTS), ("copies", _LONGS)])
PIECE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()),
                          ("whole", pa.bool_()), ("faults", _LONGS), ("audit", pa.string()),
                          ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


# ---- Spark ---------------------------------------------------------------

def rows_of(conversations: DataFrame) -> DataFrame:
    """conv, lost (the id is null), turn, role, text and copies of every row."""
    known = F.col("conv_id").cast("long")
    return conversations.select(
        F.coalesce(known, F.lit(0)).alias("conv"), known.isNull().alias("lost"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.lit(1).cast("long").alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """The same rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row
    (no copy is left; the conversation still occurs), 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's."""
    conv = F.when(F.col("lost"), " ").otherwise(F.col("conv").cast("string"))
    name = F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20

    def unless(dropped: Column, column: Column) -> Column:
        return F.when(kind == 0, dropped).otherwise(column)

    return rows.select(
        "conv", "lost", unless(F.lit(None), F.col("turn")).alias("turn"),
        unless(F.lit(""), F.when(kind == 4, "user").otherwise(F.col("role"))).alias("role"),
        unless(F.lit(""), F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
               .otherwise(F.col("text"))).alias("text"),
        (F.col("copies") * F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)).alias("copies"))


def faulty(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and the columns blank, first (of this role and
    text in its conversation) and truncated."""
    one = cut_lineage(rows.groupBy("conv", "lost", "turn", "role", "text")
                      .agg(F.sum("copies").alias("copies"))
                      .withColumn("hash", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"),
                                                          "role", "text"), 256)))
    again = one.filter("copies > 0").groupBy("conv", "lost", "hash") \
        .agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("least"))).alias("m"),
             F.count("*").alias("met")).filter("met > 1") \
        .select("conv", "lost", "hash", F.lit(True).alias("again"), F.col("m.least").alias("least"))
    white = "[\\x20\\x09-\\x0D]"
    return one.join(again, ["conv", "lost", "hash"], "left").select(
        "conv", "lost", "turn", "role", "text", "copies", "hash",
        (~F.col("text").rlike(white.replace("[", "[^"))).alias("blank"),
        (F.col("again").isNull() | F.col("turn").eqNullSafe(F.col("least"))).alias("first"),
        (~F.col("text").rlike(f"[.!?]{white}*\\z")).alias("truncated"))


def blocks_of(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = Blocks(TaskContext.get().partitionId(), block_rows, block_bytes)
        for b in batches:
            out, size = [], 0
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for block in blocks.add(row):
                    out.append(block)
                    size += sum(map(len, block[11]))
                    if size >= block_bytes:
                        yield batch(out, BLOCK_SCHEMA)
                        out, size = [], 0
            yield batch(out, BLOCK_SCHEMA)
        yield batch(list(blocks.end()), BLOCK_SCHEMA)

    keys = ["lost", "conv", F.asc_nulls_first("turn"), "role", "start", "hash"]
    dealt = rows.withColumn("start", F.substring("text", 1, 64)).repartitionByRange(*keys) \
        .sortWithinPartitions(*keys)
    return dealt.select(*[c.split()[0] for c in ROW.split(", ")]).mapInArrow(run, BLOCKS)


def _states_of_parts(table: pa.Table) -> pa.Table:
    """The states in which one conversation enters and leaves each task's share."""
    schema = pa.schema([*_ID, ("came", pa.int64()), ("went", pa.int64()), ("totals", _LONGS)])
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    folded, mids, counts = None, [], Counts()
    for r in rows:
        own = r["prefix"][:16], r["prefix"][16:32]
        counts.join(Counts.of(r["prefix"][32:], r["marks"]))
        if folded is None:
            folded = own
            mids.append([k // 4 for k in range(16)])
        else:
            *folded, mid = joined(folded, own)
            mids.append(mid)
    cost, went = last_state(*folded)
    out, totals = [], counts.faults(cost)
    for r, mid in zip(reversed(rows), reversed(mids), strict=True):
        came = mid[went]  # the conversation's start is state 0
        out.append((r["conv"], r["lost"], r["part"], came, went, totals))
        went, totals = came, None
    return pa.Table.from_batches([batch(out, schema)], schema)


def _states_of_blocks(table: pa.Table) -> pa.Table:
    """The same for the blocks of one conversation in one task."""
    schema = pa.schema([*_ID, ("number", pa.int64()), ("came", pa.int64()), ("went", pa.int64()),
                        ("totals", _LONGS)])
    rows = sorted(table.to_pylist(), key=lambda r: -r["number"])
    start, went, totals, out = rows[0]["came"], rows[0]["went"], rows[0]["totals"], []
    for r in rows:
        came = r["mids"][4 * start + went]
        out.append((r["conv"], r["lost"], r["part"], r["number"], came, went, totals))
        went, totals = came, None
    return pa.Table.from_batches([batch(out, schema)], schema)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Repaired conversations in pieces, from rows (conv, lost, turn, role, text, copies):
    conv_id, (part, number) (a conversation's pieces in order), whole (it is the only
    piece), audit and the repaired rows (role, text) of the piece; on the last piece
    also faults: gaps, blank, duplicate, truncated, illegal and cost."""
    blocks = cut_lineage(blocks_of(faulty(rows), block_rows, block_bytes))
    loose = blocks.filter("not whole")
    of = ["conv", "lost", "part"]
    parts = loose.filter("prefix is not null").select(*of, "prefix", "marks") \
        .groupBy("conv", "lost").applyInArrow(
            _states_of_parts, "conv long, lost boolean, part long, came long, went long, totals array<long>")
    states = loose.select(*of, "number", "mids").join(parts, of).groupBy(*of).applyInArrow(
        _states_of_blocks, "conv long, lost boolean, part long, number long, came long, went long, "
                           "totals array<long>")
    settled = loose.join(states, [*of, "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for conv, lost, part, number, whole, faults, audits, roles, texts, copies, came, went in \
                    zip(*[c.to_pylist() for c in b.columns], strict=True):
                audit = audits[0] if whole else audits[4 * came + went]
                if faults is not None and not whole:
                    audit += "I" * TO_END[went]
                left, _ = replay(audit, came, roles, texts, copies)
                out.append((None if lost else conv, part, number, whole, faults, audit,
                            [{"role": r, "text": t} for r, t in left]))
                size += sum(map(len, texts))
                if size >= block_bytes:
                    yield batch(out, PIECE_SCHEMA)
                    out, size = [], 0
            yield batch(out, PIECE_SCHEMA)

    names = [*of, "number", "whole", "faults", "audits", "roles", "texts", "copies"]
    start = F.lit(START).cast("long")
    return blocks.filter("whole").select(*names, start.alias("came"), start.alias("went")).unionByName(
        settled.withColumn("faults", F.col("totals")).select(*names, "came", "went")) \
        .mapInArrow(run, PIECES)


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """conv_id, part, number, place, role, text: one row per row of a repaired
    conversation; (part, number, place) orders them."""
    return pieces.select("conv_id", "part", "number", F.posexplode("repaired").alias("place", "row")) \
        .select("conv_id", "part", "number", "place", "row.role", "row.text")


def digest(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of ``role:text``, joined by line ends). A conversation in several
    pieces streams through one task."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in names],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audits, lines = hashlib.sha256(), [], 0
        for b in batches:
            out = []
            for conv_id, faults, audit, repaired in zip(*[c.to_pylist() for c in b.columns], strict=True):
                audits.append(audit)
                for row in repaired:
                    sha.update(f"{chr(10) * (lines > 0)}{row['role']}:{row['text']}".encode())
                    lines += 1
                if faults is not None:  # the last piece
                    out.append((conv_id, *faults, "".join(audits), sha.hexdigest()))
                    sha, audits, lines = hashlib.sha256(), [], 0
            yield batch(out, schema)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.select("conv_id", "faults", "audit", "repaired").mapInArrow(
            run, "conv_id long, " + "".join(f"{n} long, " for n in names)
            + "audit string, repaired_sha256 string")

    many = pieces.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return summed(pieces.filter("whole")).unionByName(summed(many))


def repair_digest(conversations: DataFrame, block_rows: int = BLOCK_ROWS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Damages every conversation, repairs it and returns its digest."""
    return digest(cut_lineage(repair(damaged(rows_of(conversations)), block_rows, block_bytes)))
