"""Conversation repair against a plain shortest-path search over all audits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from orderlens.llm import conversation_repair as cr

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """All results of one conversation's (turn, role, text) rows, by a search in order of
    (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault is not None:
            counts[fault] += 1
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for new, name in (("u", "user"), ("a", "assistant")):
            if new in allowed[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, new, (*lines, name + ":")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if faults[i] in (0, 1):
            continue
        cut = 5 if faults[i] == 2 else 0
        if role[:1] and role[:1] in allowed[state]:
            heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        for new, name in (("u", "user"), ("a", "assistant")):
            if new in allowed[state]:
                heapq.heappush(heap, (cost + 1 + cut, audit + "R", i + 1, new, (*lines, f"{name}:{text}")))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest)


def expected(rows):
    convs: dict = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for conv in convs:
        convs[conv] = plain(damage([r for r in rows if r[0] == conv]))
    return convs


def results(frame):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def random_rows(rng, conv, n, roles=("user", "assistant", "system", "tool", "", None)):
    texts = ["Hi.", "Hi", "Yes!", "  ", "", None, "Why?", "a\nb", "No. Well"]
    rows = []
    for turn in range(n):
        at = rng.choice([turn, turn, turn, turn + 3, None])
        rows.append((conv, at, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    return rows


def test_every_small_conversation_takes_the_least_cheapest_audit():
    rng = random.Random(3)
    for _ in range(400):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randrange(0, 9)))
        rows, seen = [], 0
        steps = cr.block_steps(kinds)
        last, cost = cr.closing_state(steps)
        role = [("sua"[k // 3 : k // 3 + 1] or "x") for k in kinds]
        text = [("" if k % 3 == cr.DROP else f"t{i}" if k % 3 == cr.TRUNCATED else f"t{i}.") for i, k in enumerate(kinds)]
        audit, lines = cr.repair_block(kinds, role, text, 0, last, True)
        want = plain([(i, r, t) for i, (r, t) in enumerate(zip(role, text))])
        assert (cost, audit) == want[5:7]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[7]


@pytest.mark.parametrize("block_rows", [1, 3, 2048])
def test_conversations_in_blocks_equal_a_plain_search(spark, monkeypatch, block_rows):
    """Nulls in every column, ties of turns, repeated rows, unknown roles, one conversation far
    longer than a block, clashing extra columns."""
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(cr._Block, "full", lambda self: len(self.kinds) >= block_rows)
    rng = random.Random(block_rows)
    rows = [r for conv in range(40) for r in random_rows(rng, conv, rng.randrange(1, 9))]
    rows += random_rows(rng, 100, 150, ("user", "assistant"))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ok.")] + rows[:5]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, part string")
    assert results(cr.repair_conversations(cr.damaged(frame.repartition(5)))) == expected(rows)


def test_rows_as_they_are_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    rows = [("a", 0, "system", "S."), ("a", 1, "user", "Q?"), ("a", 2, "assistant", "A."), ("b", 0, "user", "Q?"), ("b", 3, "user", "So")]
    got = results(cr.repair_conversations(cr.whole(spark.createDataFrame(rows, schema))))
    assert got == {c: plain([r[1:] for r in rows if r[0] == c]) for c in "ab"}
    assert got["a"][5:7] == (0, "KKK")
    empty = spark.createDataFrame([], schema)
    assert cr.repair_conversations(cr.damaged(empty)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    from orderlens.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.op13_conversation_repair(spark, sf)) == expected(rows)


def test_a_very_long_conversation_takes_linear_space():
    rng = random.Random(1)
    kinds = bytes(rng.randrange(12) for _ in range(60_000))
    last, cost = cr.closing_state(cr.block_steps(kinds))
    audit, _ = cr.repair_block(kinds, ["x"] * len(kinds), [""] * len(kinds), 0, last, True)
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    cut, i = 0, 0
    for letter in audit:
        if letter != "I":
            cut += 5 if letter != "D" and kinds[i] % 3 == cr.TRUNCATED else 0
            i += 1
    assert i == len(kinds) and sum(price[c] for c in audit) + cut == cost
