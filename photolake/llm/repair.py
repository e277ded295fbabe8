"""Conversation structure repair: cheapest edits to roles `(s?(ua)+)?` by branch and bound.

Of a row only its role's initial and its fault matter. Depth-first search with
an explicit stack tries edits row by row. From a row on it costs at least the
suffix bound: what faults force, and an edit for each of a heaviest set of
disjoint pairs of neighbours that can't follow one another. Prefixes whose cost
and bound exceed the incumbent's cost are left. The table of a node (row, what
was written last, whether just inserted) holds its bound, raised when a visit
ends without a way within the incumbent, or its proven cheapest completion with
its first edit. A prefix that comes to a node later is judged by that entry and
isn't carried on unless it is cheaper and nothing is proven. Edits at one node
have different letters, so the letter decides between equal costs, and the
incumbent's audit is read off the entries.

Rows are dealt by ranges of (conversation, turn). A piece of a conversation
that is long or lies across two tasks is solved for each role that it may
follow and end with, and the pieces' costs and audits are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.session import table, use_package

#: Costs of edits: Keep nothing, Rerole, Delete, Insert; a truncated row that isn't deleted adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What was written last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = "suax"  # x: any other
#: What a kept row leads to behind each state; -1: it can't stand there.
KEPT = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1, -1, -1, -1))
#: What an inserted or reroled row leads to: one role alone fits.
FITTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {"su", "ua", "au"}
#: Where a conversation may end.
ENDS = (START, ASSISTANT)
#: Faults; a row's code is 3 * its initial's place + fault.
FINE, CUT, BLANK, DUPLICATE = range(4)
FORCED = (0, TRUNCATED, DELETE, DELETE)
#: Rows of a conversation that are searched at once.
PIECE = 2000
DAMAGES = 20
NEVER = 1 << 60
SPACE = " \t\n\x0b\f\r"


class Search:
    """Cheapest edits of the rows of codes from a state to one of `ends`; `last` if the conversation ends there."""

    def __init__(self, codes: bytes, begin: int, ends: tuple[int, ...], last: bool):
        self.codes, self.ends, self.last = codes, ends, last
        self.expanded = 0
        self._bounds()
        #: Per node: proven (cost, first edit) of its cheapest completion, or a raised bound.
        self.proven: dict[tuple[int, int, bool], tuple[int, str]] = {}
        self.raised: dict[tuple[int, int, bool], int] = {}
        self.result = self._run((0, begin, False))

    def _bounds(self) -> None:
        """From each row on: what faults force, the heaviest disjoint clashes, and the first row that may stay."""
        n = len(self.codes)
        self.forced, self.clash, self.stays = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            fault = self.codes[i] & 3
            self.forced[i] = self.forced[i + 1] + FORCED[fault]
            if fault >= BLANK:
                self.clash[i], self.stays[i] = self.clash[i + 1], self.stays[i + 1]
                continue
            self.stays[i] = i
            k = self.stays[i + 1]
            self.clash[i] = self.clash[k]
            if k < n and INITIALS[self.codes[i] >> 2] + INITIALS[self.codes[k] >> 2] not in LEGAL:
                self.clash[i] = max(self.clash[k], min(self._edit(i), self._edit(k)) + self.clash[self.stays[k + 1]])
            elif k == n and self.last and INITIALS[self.codes[i] >> 2] != "a":
                self.clash[i] = self._edit(i)

    def _edit(self, i: int) -> int:
        """The least that an edit to a row or beside it adds to what its fault forces: deleting a truncated row adds little."""
        return DELETE - TRUNCATED if self.codes[i] & 3 == CUT else min(REROLE, INSERT)

    def bound(self, node: tuple[int, int, bool]) -> int:
        """What a completion of the node costs at least."""
        if node in self.raised:
            return self.raised[node]
        i, state, _ = node
        k, n = self.stays[i], len(self.codes)
        ahead = self.clash[k]
        if k < n and KEPT[self.codes[k] >> 2][state] < 0:
            ahead = max(ahead, self._edit(k) + self.clash[self.stays[k + 1]])
        elif k == n and self.last and state not in self.ends:
            ahead = INSERT
        return self.forced[i] + ahead

    def edits(self, node: tuple[int, int, bool]) -> list[tuple[int, str, int, tuple[int, int, bool]]]:
        """Edits at a node as (least cost, letter, own cost, node behind), the most promising last."""
        i, state, inserted = node
        out = []
        if i < len(self.codes):
            initial, fault = self.codes[i] >> 2, self.codes[i] & 3
            out.append(("D", DELETE, (i + 1, state, False)))
            if fault < BLANK:
                if KEPT[initial][state] >= 0:
                    out.append(("K", FORCED[fault], (i + 1, KEPT[initial][state], False)))
                out.append(("R", REROLE + FORCED[fault], (i + 1, FITTED[state], False)))
        if not inserted and (i < len(self.codes) or self.last):  # two in a row never pay; between pieces, the later one inserts
            out.append(("I", INSERT, (i, FITTED[state], True)))
        return sorted(((cost + (self.proven[to][0] if to in self.proven else self.bound(to)), letter, cost, to) for letter, cost, to in out), reverse=True)

    def _run(self, root: tuple[int, int, bool]) -> tuple[int, str] | None:
        incumbent = NEVER
        stack: list[list] = []

        def visit(node: tuple[int, int, bool], cost: int) -> None:
            ends = node[0] == len(self.codes) and node[1] in self.ends
            stack.append([node, cost, [] if ends else self.edits(node), (0, "") if ends else (NEVER, ""), NEVER])
            self.expanded += 1

        visit(root, 0)
        while stack:
            frame = stack[-1]
            node, cost, left, best, least = frame
            incumbent = min(incumbent, cost + best[0])
            if not left:  # what was left out costs `least` at least
                if best[0] < least or best[0] == NEVER == least:
                    self.proven[node] = best
                else:
                    self.raised[node] = min(best[0], least)
                stack.pop()
                continue
            _, letter, own, to = left[-1]
            if to in self.proven:
                left.pop()
                frame[3] = min(best, (own + self.proven[to][0], letter)) if self.proven[to][0] < NEVER else best
            elif cost + own + self.bound(to) > incumbent:
                left.pop()
                frame[4] = min(least, own + self.bound(to))
            else:
                visit(to, cost + own)  # afterwards it is proven, or its bound exceeds the incumbent
        total = self.proven[root][0]
        return None if total == NEVER else (total, self._audit(root))

    def _audit(self, node: tuple[int, int, bool]) -> str:
        out = []
        while letter := self.proven[node][1]:
            out.append(letter)
            node = next(to for _, x, _, to in self.edits(node) if x == letter)
        return "".join(out)


@lru_cache(1 << 14)
def _short(codes: bytes, begin: int, ends: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    return Search(codes, begin, ends, last).result


def repair(codes: bytes, begin: int = START, ends: tuple[int, ...] = ENDS, last: bool = True) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits; None if none leads there."""
    return _short(codes, begin, ends, last) if len(codes) <= 64 else Search(codes, begin, ends, last).result


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: each row after damage and how often it stands there; dropped rows stay with n = 0."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    mark = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    d = turns.select("conv_id", "turn", *said, (F.crc32(mark.cast("binary")) % DAMAGES).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).cast("long").alias("n"))


ORDER = ["turn", "role", "digest"]  # nulls first


def facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code, n and whether the first of them is the conversation's first of its role and text.

    Equal rows of a turn are counted first, and the earliest turn of a text is an
    aggregate, so that texts said again and again meet nowhere.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    place = F.array_position(F.array(*map(F.lit, INITIALS[:3])), F.left("role", F.lit(1)))  # from 1, 0 for others
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    coded = rows.select("conv_id", "turn", "role", "n", F.unhex(F.sha2("text", 256)).alias("digest"), ((place + 3) % 4 * 4 + fault).cast("int").alias("code"))
    one = coded.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("code").alias("code"))
    there = F.when(F.col("n") > 0, F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = one.groupBy("conv_id", "role", "digest").agg(F.min(there).alias("earliest"))
    named = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("earliest.turn").alias("t"), "earliest")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return one.join(named, same).select("conv_id", "turn", "role", "digest", "code", "n", F.coalesce(F.col("turn").eqNullSafe(F.col("t")), F.lit(False)).alias("first"))


SOLVED = "struct<begin int, end int, cost long, audit string>"
PIECES = f"conv_id long, part int, piece int, n long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head string, tail string, ways array<{SOLVED}>"


class _Piece:
    """Rows of a conversation that follow one another in a task."""

    def __init__(self, conv: int | None, begins: bool):
        self.conv, self.begins = conv, begins
        self.codes = bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, code: int, n: int, first: bool) -> None:
        if not n:
            return
        again = code if code & 3 == BLANK else code & ~3 | DUPLICATE
        self.codes.append(code if first else again)
        self.codes.extend(bytes([again]) * (n - 1))
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def row(self, part: int, piece: int, ends: bool) -> tuple:
        codes = bytes(self.codes)
        roles = "".join(INITIALS[x >> 2] for x in codes)
        faults = [x & 3 for x in codes]
        asked = [(START, ENDS, -1)] if self.begins and ends else [(b, e, x) for b in STATES for e, x in (*(((s,), s) for s in STATES), (ENDS, -1))]
        ways = [{"begin": b, "end": x, "cost": found[0], "audit": found[1]} for b, e, x in asked if (found := repair(codes, b, e, x < 0))]
        illegal = sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
        return (self.conv, part, piece, len(codes), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, self.low, self.high, self.turns, roles[:1], roles[-1:], ways)


def pieces(known: DataFrame, limit: int = PIECE) -> DataFrame:
    """Conversations, or their pieces in the order of part and piece, with counts and cheapest edits."""
    use_package(known.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, rows = TaskContext.get().partitionId(), 0, None, []
        names = [x.strip().split(" ")[0] for x in PIECES.split(", ways")[0].split(",")] + ["ways"]
        kind = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), *((x, pa.int64()) for x in names[3:11]), ("head", pa.string()), ("tail", pa.string()), ("ways", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], kind)
            rows.clear()
            return batch

        for batch in batches:
            for conv, turn, code, n, first in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "code", "n", "first")), strict=True):
                if now is None or now.conv != conv or len(now.codes) >= limit:
                    if now is not None:
                        rows.append(now.row(part, number, now.conv != conv))
                        number += 1
                    now = _Piece(conv, now is not None and now.conv != conv)  # a task's first rows may go on from another's
                now.add(turn, code, n, first)
            yield out()
        if now is not None:
            rows.append(now.row(part, number, False))
        yield out()

    placed = known.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return placed.select("conv_id", "turn", "code", "n", "first").mapInArrow(run, PIECES)


class _Joined:
    """A conversation put together from its pieces."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}  # by state
        self.done: dict[int, tuple[int, str]] = {START: (0, "")}  # as if it ended here
        self.counts = [0, 0, 0, 0]
        self.low = self.high = None
        self.turns, self.tail, self.rows = 0, "", 0

    def add(self, p: dict) -> None:
        if not p["n"]:
            return
        into: dict[int, tuple[int, str]] = {}
        done: tuple[int, str] | None = None
        for w in p["ways"]:
            if w["begin"] in self.ways:
                cost, audit = self.ways[w["begin"]]
                found = (cost + w["cost"], audit + w["audit"])
                if w["end"] < 0:
                    done = min(done or found, found)
                else:
                    into[w["end"]] = min(into.get(w["end"], found), found)
        self.ways, self.done = into, {START: done}
        for i, x in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += p[x]
        self.counts[3] += bool(self.tail) and self.tail + p["head"] not in LEGAL
        self.tail = p["tail"]
        self.rows += p["n"]
        if p["low"] is not None:
            self.turns += p["turns"] - (p["low"] == self.high)
            self.low = p["low"] if self.low is None else self.low
            self.high = p["high"]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class _Writer:
    """The repaired conversation's digest, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: bytes, text: bytes, state: int) -> None:
        self.sha.update((b"\n" if self.any else b"") + role + b":" + text)
        self.state, self.any = state, True

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._say(ROLE[FITTED[self.state]], b"", FITTED[self.state])

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._say(role.encode(), text.encode(), KEPT[INITIALS.index(role[0])][self.state])
        elif letter == "R":
            self._say(ROLE[FITTED[self.state]], text.encode(), FITTED[self.state])


RESULT = [("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def repair_conversations(turns: DataFrame, limit: int = PIECE) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation, as its rows stand.

    turns: conv_id, turn, role, text, n; a row stands n times, and rows with
    n = 0 only name a conversation. Rows are taken by turn (nulls first), within
    a turn by role and digest of the text, so that equal rows lie together. A
    null role or text is one space, a null conv_id a conversation of its own.
    Roles are judged by their first character as it is; an empty role fits
    nowhere. Without rows: zeros, an empty audit, the digest of nothing. Other
    columns are left out; an empty table gives an empty result. Texts stream
    through one task a conversation, as a digest has to; held are only a byte a
    row and the audit.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.col("n").cast("long"))
    found = pieces(facts(rows), limit)
    texts = rows.filter("n > 0").select("conv_id", F.lit(1).alias("kind"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns if c not in ("conv_id", "n")), "n", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    both = found.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    order = ["conv_id", "kind", "part", "piece", *ORDER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: _Joined | None = None
        writer: _Writer | None = None
        out: list[tuple] = []

        def begin_writing() -> _Writer:
            return _Writer(conv.done[START][1])

        def close() -> None:
            w = writer or begin_writing()
            w.inserted()
            cost, audit = conv.done[START]
            out.append((conv.conv, conv.gaps, *conv.counts, cost, audit, w.sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(RESULT)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, RESULT, strict=True)], [x for x, _ in RESULT])

        for batch in batches:
            ids, kinds = batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist()
            roles, texts_, times = batch.column("role"), batch.column("text"), batch.column("n").to_pylist()
            for i, (c, kind) in enumerate(zip(ids, kinds, strict=True)):
                if conv is None or conv.conv != c:
                    if conv is not None:
                        close()
                    conv, writer = _Joined(c), None
                if kind == 0:
                    conv.add(batch.slice(i, 1).to_pylist()[0])
                else:
                    writer = writer or begin_writing()
                    for _ in range(times[i]):
                        writer.row(roles[i].as_py(), texts_[i].as_py())
            yield flush()
        if conv is not None:
            close()
        yield flush()

    kind = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return both.repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest").mapInArrow(run, kind)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
