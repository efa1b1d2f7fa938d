"""Cheapest repair of conversation structure by divide and conquer over four states.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: an optional
system message, then turns of user and assistant.  Four states tell where a reader stands:
nothing read, behind s, behind u, behind a.  Rows are kept (0), given the role user or
assistant that is due (1), deleted (2, a must for blank and repeated rows), and empty rows of
the due role are inserted (5); a truncated row that stays costs 5 more.  The audit is the
initials of the edits in order; of the cheapest audits the ASCII-least one counts.

* **Crossing states** (:func:`crossings`, after Hirschberg 1975): a vector of four costs runs
  forward from the first state to the middle, one runs backward from the last state, and the
  cheapest sum gives the state at the middle; both halves follow.  Space is linear.  With each
  cost the forward vector carries the rank of its least audit among the four.  Audits that end
  behind the same row with another state differ before either ends (both hold one letter
  besides I per row and end with it), so ranks are enough to pick the least one.
* **Blocks.**  Rows are range-partitioned and sorted by conversation and turn, and cut into
  blocks of at most ``BLOCK_ROWS`` rows of one conversation, so one long conversation is spread over
  many tasks.  A block is summarised by the costs and ranks between any two states; the same
  divide and conquer over a conversation's blocks gives the states at their ends, and every
  block then finds its own crossings alone.  Only summaries of a conversation meet in one task:
  a few numbers for every block.  The repaired text of a conversation of several blocks
  streams through one hash, block by block.
* **Repeated rows** are found by the first turn of each role and text, a partial aggregate
  joined back, so no conversation and no common text is gathered.

Defined results: null roles and texts read as one space; null turns come first; rows of one
turn go by role, then text; a role has the initial of its first character, and an empty role
none; a conversation id that is null is a conversation like any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import checkpoint_table

BLOCK_ROWS = 2048
BLOCK_CHARS = 4_000_000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
# state -> role initial -> next state; states: 0 nothing read, 1 behind s, 2 behind u, 3 behind a
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
# inserts that lead from one state to another
FILL = ({0: 0, 2: 1, 3: 2}, {1: 0, 2: 1, 3: 2}, {2: 0, 3: 1}, {3: 0, 2: 1})
# inserts behind the last row, by state
CLOSE = (0, 2, 1, 0)
INITIALS = "sua"
FINE, TRUNCATED, DROP = 0, 1, 2
FAR = 1 << 60


def kind_of(role: str, fault: int) -> int:
    """A row for the search: its role's initial and whether it is fine, truncated or to drop."""
    return 3 * (INITIALS.find(role[0]) if role and role[0] in INITIALS else 3) + fault


@lru_cache(maxsize=None)
def moves(kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state behind, cost, edits) of a row, the best for each two states."""
    initial, fault = INITIALS[kind // 3 : kind // 3 + 1], kind % 3
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        for q, inserts in FILL[p].items():
            options = [(q, DELETE, "D")]
            if fault != DROP:
                cut = CUT if fault == TRUNCATED else 0
                if initial in NEXT[q]:
                    options.append((NEXT[q][initial], KEEP + cut, "K"))
                options.append((NEXT[q][DUE[q][0]], REROLE + cut, "R"))
            for r, cost, letter in options:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[p, r] = min(best.get((p, r), found), found)
    return tuple((p, q, cost, edits) for (p, q), (cost, edits) in sorted(best.items()))


def forward(steps, lo: int, hi: int, state: int):
    """Costs of the four states behind step hi - 1 from ``state`` before step lo, and the
    ranks of their least cheapest audits."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[state] = 0
    for i in range(lo, hi):
        best: list = [None] * 4
        for p, q, c, edits in steps[i]:
            if cost[p] < FAR:
                found = (cost[p] + c, rank[p], edits)
                if best[q] is None or found < best[q]:
                    best[q] = found
        order = sorted(b[1:] for b in best if b is not None)
        cost = [FAR if b is None else b[0] for b in best]
        rank = [0 if b is None else order.index(b[1:]) for b in best]
    return cost, rank


def backward(steps, lo: int, hi: int, state: int):
    """Costs from each of the four states before step lo to ``state`` behind step hi - 1."""
    cost = [FAR] * 4
    cost[state] = 0
    for i in range(hi - 1, lo - 1, -1):
        best = [FAR] * 4
        for p, q, c, _ in steps[i]:
            if cost[q] + c < best[p]:
                best[p] = cost[q] + c
        cost = best
    return cost


def crossings(steps, first: int, last: int) -> list[int]:
    """The state before each step and behind the last one, on the least cheapest audit from
    ``first`` to ``last``."""
    n = len(steps)
    states = [first] * (n + 1)
    states[n] = last
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead, rank = forward(steps, lo, mid, states[lo])
        behind = backward(steps, mid, hi, states[hi])
        states[mid] = min(range(4), key=lambda s: (ahead[s] + behind[s], rank[s]))
        todo += [(lo, mid), (mid, hi)]
    return states


def closing_state(steps) -> tuple[int, int]:
    """(last state, cost) of the cheapest audit over all steps from the start, closing inserts
    included."""
    cost, rank = forward(steps, 0, len(steps), 0)
    last = min(range(4), key=lambda s: (cost[s] + INSERT * CLOSE[s], rank[s]))
    return last, cost[last] + INSERT * CLOSE[last]


def block_steps(kinds: bytes):
    return [moves(k) for k in kinds]


def summarise(kinds: bytes) -> list[int]:
    """16 costs and 16 ranks between the states before and behind a block."""
    steps = block_steps(kinds)
    found = [forward(steps, 0, len(steps), p) for p in range(4)]
    return [c for cost, _ in found for c in cost] + [r for _, rank in found for r in rank]


def block_moves(summary: list[int]):
    """A summary as a step: ranks stand for edits."""
    return [
        (p, q, summary[4 * p + q], summary[16 + 4 * p + q]) for p in range(4) for q in range(4) if summary[4 * p + q] < FAR
    ]


def repair_block(kinds: bytes, roles, texts, first: int, last: int, closing: bool) -> tuple[str, list[str]]:
    """(audit, repaired lines ``role:text``) of a block between two states."""
    states = crossings(block_steps(kinds), first, last)
    audit, lines = [], []

    def insert(state: int) -> int:
        lines.append(DUE[state] + ":")
        return NEXT[state][DUE[state][0]]

    for i, kind in enumerate(kinds):
        p, q = states[i], states[i + 1]
        edits = next(e for a, b, _, e in moves(kind) if (a, b) == (p, q))
        audit.append(edits)
        for letter in edits:
            if letter == "I":
                p = insert(p)
            elif letter == "R":
                lines.append(f"{DUE[p]}:{texts[i]}")
            elif letter == "K":
                lines.append(f"{roles[i]}:{texts[i]}")
    if closing:
        audit.append("I" * CLOSE[last])
        state = last
        for _ in range(CLOSE[last]):
            state = insert(state)
    return "".join(audit), lines


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage by crc32 of ``conv_id:turn`` modulo
    20 -- 0 drops a row (no copies), 1 empties its text, 2 removes its sentence marks, 3 repeats
    it, 4 sets its role to user.  A dropped row stays as a row without copies."""
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), space).alias("role"),
        F.coalesce(F.col("text"), space).alias("text"),
        F.expr("crc32(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))) % 20").alias("k"),
    )
    return rows.select(
        "conv_id",
        F.expr("CASE WHEN k > 0 THEN turn END").alias("turn"),
        F.expr("CASE k WHEN 0 THEN '' WHEN 4 THEN 'user' ELSE role END").alias("role"),
        F.expr(r"CASE WHEN k <= 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END").alias("text"),
        F.expr("CASE k WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END").alias("copies"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with equal ones counted together: (conv_id, turn, role, text, copies, seen, fault).
    ``seen``: the role and text stand in an earlier turn.  fault: 1 blank, 2 truncated, else 0."""
    alive = rows.groupBy("conv_id", "turn", "role", "text", (F.col("copies") > 0).alias("alive")).agg(
        F.sum("copies").alias("copies")
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = (
        rows.filter("copies > 0").groupBy("conv_id", "role", "text").agg(F.min(order).alias("first"))
    ).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first")
    marked = alive.join(
        firsts, alive.conv_id.eqNullSafe(firsts.c) & (alive.role == firsts.r) & (alive.text == firsts.t) & F.col("alive"), "left"
    ).withColumn("trimmed", F.rtrim("text", F.lit("\t\n\x0b\f\r ")))
    return marked.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        F.coalesce(~order.eqNullSafe(F.col("first")), F.lit(False)).alias("seen"),
        F.expr("CASE WHEN trimmed = '' THEN 1 WHEN right(trimmed, 1) IN ('.', '!', '?') THEN 0 ELSE 2 END").alias("fault"),
    )


class _Block:
    """Rows of one conversation on their way into a block."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.kinds = bytearray()
        self.roles, self.texts = [], []
        self.chars = 0
        self.counts = [0, 0, 0]  # blank, duplicate, truncated
        self.illegal = 0
        self.first = self.last = None  # initials at the ends
        self.turns: list = []  # known turns, ascending, each once

    def add(self, turn, role: str, text: str, fault: int, seen: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        drop = fault == 1 or seen
        if fault == 1:
            self.counts[0] += 1
        elif seen:
            self.counts[1] += 1
        elif fault == 2:
            self.counts[2] += 1
        self.kinds.append(kind_of(role, DROP if drop else TRUNCATED if fault == 2 else FINE))
        self.roles.append("" if drop else role)
        self.texts.append("" if drop else text)
        self.chars += len(self.texts[-1])
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self) -> bool:
        return len(self.kinds) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def row(self, part: int, seq: int):
        t = self.turns
        stats = [*self.counts, self.illegal, len(t)]
        return (
            self.conv_id, part, seq, bytes(self.kinds), self.roles, self.texts, summarise(bytes(self.kinds)), stats,
            self.first, self.last, t[0] if t else None, t[-1] if t else None,
        )


BLOCK_FIELDS = (
    "part int, seq int, kinds binary, roles array<string>, texts array<string>, summary array<long>, stats array<long>, "
    "first string, last string, low long, high long"
)


def _arrow_schema(*fields):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "str": pa.string(), "bin": pa.binary(), "bool": pa.bool_()}
    kinds |= {"strs": pa.list_(pa.string()), "longs": pa.list_(pa.int64())}
    return [(name, kinds.get(kind, kind)) for name, kind in fields]


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, schema)], [name for name, _ in schema]
    )


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """The stored blocks of all conversations, ordered by (part, seq)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked = _faults(rows.withColumn("turn", F.col("turn").cast("long")))
    nulls_first = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    # bounds of the ranges hold the texts' beginnings only; equal beginnings share a range
    dealt = marked.repartitionByRange(*nulls_first[:2], F.substring("role", 1, 16), F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions(*nulls_first)

    def run(batches):
        from pyspark import TaskContext

        part, seq, block, ready, size = TaskContext.get().partitionId(), 0, None, [], 0
        schema = None
        for batch in batches:
            if schema is None:
                schema = _arrow_schema(
                    ("conv_id", batch.schema.field("conv_id").type), ("part", "int"), ("seq", "int"), ("kinds", "bin"),
                    ("roles", "strs"), ("texts", "strs"), ("summary", "longs"), ("stats", "longs"), ("first", "str"),
                    ("last", "str"), ("low", "long"), ("high", "long"),
                )
            for lo in range(0, batch.num_rows, 1024):
                for r in batch.slice(lo, 1024).to_pylist():
                    if block is not None and (block.conv_id != r["conv_id"] or block.full()):
                        ready.append(block.row(part, seq))
                        size, seq, block = size + 1 + block.chars, seq + 1, None
                    if block is None:
                        block = _Block(r["conv_id"])
                    for copy in range(r["copies"]):
                        block.add(r["turn"], r["role"], r["text"], r["fault"], r["seen"] or copy > 0)
                        if block.full() and copy + 1 < r["copies"]:
                            ready.append(block.row(part, seq))
                            size, seq, block = size + 1 + block.chars, seq + 1, _Block(r["conv_id"])
                    if size >= BLOCK_CHARS or len(ready) >= 4096:
                        yield _batch(ready, schema)
                        ready, size = [], 0
        if block is not None:
            ready.append(block.row(part, seq))
        if ready:
            yield _batch(ready, schema)

    return checkpoint_table(ordered.mapInArrow(run, f"conv_id {kind}, {BLOCK_FIELDS}"), "conversation-blocks")


def _runs(batches, key: str):
    """Lists of consecutive rows (as dicts) with one value of ``key``."""
    run: list[dict] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            for r in batch.slice(lo, 1024).to_pylist():
                if run and run[0][key] != r[key]:
                    yield run
                    run = []
                run.append(r)
    if run:
        yield run


def block_states(blocks: DataFrame) -> DataFrame:
    """(part, seq, p, q, closing, alone, stats): the states at the ends of every block; a conversation's
    last block carries gaps, blank, duplicate, truncated, illegal and cost."""
    small = blocks.select("conv_id", "part", "seq", "summary", "stats", "first", "last", "low", "high", F.length("kinds").alias("n"))
    ordered = small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches):
        schema = _arrow_schema(
            ("part", "int"), ("seq", "int"), ("p", "int"), ("q", "int"), ("closing", "bool"), ("alone", "bool"), ("totals", "longs")
        )
        out = []
        for rows in _runs(batches, "conv_id"):
            live = [r for r in rows if r["n"]] or rows[:1]
            steps = [block_moves(r["summary"]) for r in live]
            last, cost = closing_state(steps)
            states = crossings(steps, 0, last)
            sums = [sum(r["stats"][k] for r in live) for k in range(4)]
            ends = [(a["last"], b["first"]) for a, b in zip(live, live[1:])]
            sums[3] += sum(a + b not in ("su", "ua", "au") for a, b in ends)
            known = [r for r in live if r["low"] is not None]
            distinct = sum(r["stats"][4] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
            gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
            for i, r in enumerate(live):
                closing = i == len(live) - 1
                totals = [gaps, *sums, cost] if closing else None
                out.append((r["part"], r["seq"], states[i], states[i + 1], closing, len(live) == 1, totals))
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(
        run, "part int, seq int, p int, q int, closing boolean, alone boolean, totals array<long>"
    )


def whole(conversations: DataFrame) -> DataFrame:
    """Conversation rows as they are, in the form of :func:`damaged`."""
    space = F.lit(" ")
    return conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"),
        F.lit(1).cast("long").alias("copies"),
    )


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies), as :func:`whole` and
    :func:`damaged` give them: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256).  A conversation without rows has zeros, an empty audit and the empty text's hash."""
    import hashlib

    blocks = conversation_blocks(rows)
    kind = blocks.schema["conv_id"].dataType.simpleString()
    placed = blocks.select("conv_id", "part", "seq", "kinds", "roles", "texts").join(block_states(blocks), ["part", "seq"])

    def repair(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(lo, 256)
                for r in part.to_pylist():
                    audit, lines = repair_block(r["kinds"], r["roles"], r["texts"], r["p"], r["q"], r["closing"])
                    text = "\n".join(lines)
                    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if r["alone"] else None
                    out.append((r["conv_id"], r["part"], r["seq"], audit, None if r["alone"] or not lines else text, digest, r["totals"]))
                yield _batch(
                    out,
                    _arrow_schema(
                        ("conv_id", part.schema.field("conv_id").type), ("part", "int"), ("seq", "int"), ("audit", "str"),
                        ("text", "str"), ("digest", "str"), ("totals", "longs"),
                    ),
                )

    pieces = placed.mapInArrow(
        repair, f"conv_id {kind}, part int, seq int, audit string, text string, digest string, totals array<long>"
    )
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def finish(batches):
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        out, schema = [], None
        conv, audit, digest, begun, totals, open_ = None, [], None, False, None, False

        def row():
            done = digest if isinstance(digest, str) else digest.hexdigest()
            return (conv, *totals, "".join(audit), done)

        for batch in batches:
            if schema is None:
                schema = _arrow_schema(
                    ("conv_id", batch.schema.field("conv_id").type), *((n, "long") for n in names), ("audit", "str"),
                    ("repaired_sha256", "str"),
                )
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    if not open_:
                        conv, audit, begun, open_ = r["conv_id"], [], False, True
                        digest = r["digest"] or hashlib.sha256()
                    audit.append(r["audit"])
                    if r["text"] is not None:
                        digest.update((("\n" if begun else "") + r["text"]).encode("utf-8", "surrogatepass"))
                        begun = True
                    if r["totals"] is not None:  # the conversation's last block
                        totals, open_ = r["totals"], False
                        out.append(row())
                        if len(out) >= 4096:
                            yield _batch(out, schema)
                            out = []
        if out:
            yield _batch(out, schema)

    longs = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return ordered.mapInArrow(finish, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
