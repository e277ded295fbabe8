"""Conversation repair against a plain search over all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from photolake.llm import repair

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
FIT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def _cheapest(rows):
    """(cost, audit) by relaxing over rows and what was written last; rows of (role, fault)."""

    def with_inserts(layer):
        while True:
            more = dict(layer)
            for state, (cost, audit) in layer.items():
                to, found = FIT[state][0], (cost + 3, audit + "I")
                more[to] = min(more.get(to, found), found)
            if more == layer:
                return layer
            layer = more

    layer = with_inserts({"": (0, "")})
    for role, fault in rows:
        new = {}
        for state, (cost, audit) in layer.items():
            tries = [(state, (cost + 4, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                i = role[:1]
                if i == "s" and state == "" or i == "u" and state != "u" or i == "a" and state == "u":
                    tries.append((i, (cost + more, audit + "K")))
                tries.append((FIT[state][0], (cost + 3 + more, audit + "R")))
            for to, found in tries:
                new[to] = min(new.get(to, found), found)
        layer = with_inserts(new)
    return min(layer[x] for x in ("", "a") if x in layer)


def _expected(table):
    out, convs = {}, collections.defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv]
        if h != 0:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            convs[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = _cheapest([(r[1], f) for r, f in zip(rows, faults, strict=True)])
        at, state, lines = 0, "", []
        for letter in audit:
            role, text = (None, "") if letter == "I" else rows[at][1:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else FIT[state]
                state = role[0]
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def _odd():
    r = random.Random(5)
    said = ["", " \t", "One.", "Two?", "Three", "Four! ", "no end \n", None, "é.", "ends . here"]
    rows = [(c, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), r.choice(said) if r.random() < 0.6 else f"Said {r.random()}.") for c in range(60) for t in range(r.randint(0, 12))]
    rows += [(None, None, "user", "Hello."), (None, 3, "assistant", "Yes."), (7, None, "user", "early."), (7, None, "user", "early."), (7, 2, "user", "tie b."), (7, 2, "user", "tie a."), (61, -5, "assistant", "x" * 300_000)]
    rows += [(100, t, ("user", "assistant")[t % 2] if t % 17 else "user", f"turn {t % 50}." if t % 11 else "again.") for t in range(400)]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("limit", [3, repair.PIECE])
def test_odd_conversations(spark, limit):
    table = _odd()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(table, TURNS).selectExpr("*", "1 AS n", "'x' AS digest").repartition(5)
        assert _got(repair.repair_conversations(repair.damaged(df), limit)) == _expected(table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repair.repair_conversations(repair.damaged(df.filter("1 = 0"))).count() == 0


def test_given_conversations(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(repair.op13_conversation_repair(spark, SF)) == _expected(table)


def test_search_equals_a_plain_one_and_stays_small():
    r = random.Random(2)
    names = ["", "truncated", "blank", "duplicate"]
    for n in [*(r.randint(0, 12) for _ in range(2000)), 300, 1500]:
        codes = bytes(r.choice([0, 1, 1, 2, 2, 3]) * 4 + r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        found = repair.Search(codes, repair.START, repair.ENDS, True)
        assert found.result == _cheapest([("suax"[x >> 2], names[x & 3]) for x in codes])
        assert found.expanded <= 8 * (n + 1)


def test_bound_is_one():
    """No suffix bound exceeds what the cheapest edits from there cost."""
    r = random.Random(4)
    for _ in range(300):
        codes = bytes(r.choice([0, 1, 2, 3]) * 4 + r.choice([0, 0, 1, 2]) for _ in range(r.randint(1, 9)))
        for begin in repair.STATES:
            found = repair.Search(codes, begin, repair.ENDS, True)
            found.raised.clear()
            if found.result:
                assert found.bound((0, begin, False)) <= found.result[0]
