"""Secret scan with assignment-aware lexing.

Three base patterns find secrets anywhere in a text.  The lexer adds what they miss: it
looks at every ``=``, ``:``, ``:=`` and ``=>`` (and ``<name>value</name>``), reads the name
on its left (identifier path, quoted key, subscript) and the expression on its right: quoted
literals, identifiers, bare configuration values, joined by ``+``, ``.`` or adjacency, with
chained targets.  Identifiers are replaced by the literals last assigned to them in the
same text, so ``a = "x..."; password = a`` reports the literal of the first statement.  Each
literal gets the score of its target name plus a score of its own characters, and is
reported from ``THRESHOLD`` on.  Spans count code points, end exclusive.

The lexer jumps from operator to operator, so prose costs one scan for two characters.  Line
starts, runs of bare characters and base spans are followed forward, each read once, so a long
one-line text or a long list of credentials takes time in proportion to its length.

Defined results: a null text is empty (no spans); rows are handled one by one, so repeated
rows and null or repeated ids give a row each; an empty table gives an empty result; other
columns are ignored, or kept by :func:`redact_documents`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.tokens import text_slices

# The base patterns and the length from which a match counts.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_MIN = 24
KINDS = ("assign", "access", "hex", "literal")

THRESHOLD = 1.0
MIN_LITERAL = 6
# Words of a target name and their weight; a name scores its best word or word pair.
NAME_WEIGHTS = {
    "password": 0.9, "passwd": 0.9, "pwd": 0.8, "passphrase": 0.9, "passcode": 0.8, "secret": 0.9, "token": 0.7,
    "credential": 0.8, "credentials": 0.8, "apikey": 0.9, "auth": 0.5, "bearer": 0.7, "pin": 0.3, "salt": 0.4,
    "api key": 0.9, "access key": 0.9, "private key": 0.9, "secret key": 0.9, "client secret": 0.9,
    "signing key": 0.9, "encryption key": 0.9, "session key": 0.8, "master key": 0.9, "connection string": 0.6,
}
# Words that make a name describe a secret instead of holding one.
NAME_DAMPERS = {
    "count", "counts", "len", "length", "size", "max", "min", "limit", "type", "name", "field", "label", "hint", "url",
    "uri", "path", "file", "dir", "id", "index", "policy", "regex", "pattern", "public", "placeholder", "prompt",
    "expiry", "ttl", "enabled", "required", "reset", "header", "param",
}
PLACEHOLDER = re.compile(
    r"^(?:\$\{.*\}|\{\{.*\}\}|<.*>|%\(.*\)s|\*+|x+|\.+|none|null|nil|true|false|undefined|changeme|change_me"
    r"|your[_ -].*|example.*|todo|redacted|\[redacted\]|\[secret\])$",
    re.IGNORECASE,
)

_OPERATOR = re.compile(r"[=:]")
_QUOTED = re.compile(r'"""(.*?)"""|\'\'\'(.*?)\'\'\'|"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`', re.DOTALL)
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
_BARE = re.compile(r"[^\s\"'`,;#<>(){}\[\]|]+")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</\1>")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.$-")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_BLANKS = " \t"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping per kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    return out + [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]


# A run of at least HEX_MIN characters starts where its maximal run starts, so this finds
# the runs of HEX that are long enough without stopping at every short one.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)


def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 0.9."""
    words = [w.lower() for w in _WORDS.findall(name)]
    units = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    best = max((NAME_WEIGHTS.get(u, 0.0) for u in units), default=0.0)
    return best * (0.3 if NAME_DAMPERS.intersection(words) else 1.0)


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 0.6; below 0 for placeholders."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value):
        return -1.0
    return _character_score(len(value), Counter(value), quoted)


def _character_score(length: int, counts: dict[str, int], quoted: bool) -> float:
    bits = -sum(c / length * math.log2(c / length) for c in counts.values())
    kinds = sum(any(t(c) for c in counts) for t in (str.islower, str.isupper, str.isdigit)) + any(
        not c.isalnum() and not c.isspace() for c in counts
    )
    score = 0.15 * (bits >= 2.0) + 0.15 * (bits >= 3.0) + 0.15 * (kinds >= 2) + 0.15 * (kinds >= 3)
    # A bare value of one kind of character is most likely a word of prose.
    return score if quoted else (score - 0.1 if kinds >= 2 else -1.0)


def _name_before(text: str, at: int, line: int) -> str:
    """The assignment target that ends at ``at``, on the line that starts at ``line``."""
    i = at - 1
    while i >= 0 and text[i] in _BLANKS:
        i -= 1
    if i >= 0 and text[i] == "]":
        i -= 1
    if i >= 0 and text[i] in "\"'`":
        close = text.rfind(text[i], line, i)
        return text[close + 1 : i] if close >= 0 else ""
    end = i + 1
    while i >= 0 and text[i] in _NAME_CHARS:
        i -= 1
    return text[i + 1 : end].strip("-.")


def _operator(text: str, at: int) -> int:
    """End of the assignment operator at ``at``, or -1 for comparisons, URLs and scopes."""
    c, before, after = text[at], text[at - 1 : at], text[at + 1 : at + 2]
    if c == "=":
        if before and before in "=!<>" or after == "=" or before == ":":
            return -1
        return at + 2 if after == ">" else at + 1
    if after == "=":
        return at + 2
    return -1 if after == ":" or before == ":" or text[at + 1 : at + 3] == "//" else at + 1


Piece = tuple[int, int, bool]
_CHAINED = re.compile(r"[ \t]*=(?![=>])")
# Characters kept of both ends of a long value; no PLACEHOLDER word is as long.
_ENDS = 64


class Value:
    """An expression's literals (pieces) and constants (shared values), in order."""

    __slots__ = ("parts", "run", "summary", "reported")

    def __init__(self, parts: list[Piece | Value], run: BareRun | None = None):
        self.parts, self.run, self.summary, self.reported = parts, run, None, False

    def _summarize(self, text: str) -> None:
        length, counts, head, tail, quoted = 0, Counter(), "", "", True
        for p in self.parts:
            if isinstance(p, Value):
                n, c, h, t, q = p.summary
            else:
                a, b, q = p
                c = self.run.characters(text, a, b) if self.run else Counter(text[a:b])
                n, h, t = b - a, text[a : min(b, a + _ENDS)], text[max(a, b - _ENDS) : b]
            if len(head) < _ENDS:
                head = (head + h)[:_ENDS]
            length, tail, quoted = length + n, (tail + t)[-_ENDS:], quoted and q
            counts.update(c)
        if length >> 256:  # doubled over and over: the shares of the characters are all that counts
            shift = length.bit_length() - 128
            counts = Counter({k: max(1, n >> shift) for k, n in counts.items()})
            length = sum(counts.values())
        self.summary = (length, counts, head, tail, quoted)

    def _below(self, skip) -> list[Value]:
        """This value and those it is made of that ``skip`` does not stop at, parts first."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, left = stack.pop()
            if left:
                order.append(v)
            elif id(v) not in seen and not skip(v):
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parts if isinstance(p, Value)]
        return order

    def score(self, text: str) -> float:
        """``literal_score`` of the whole value, which is never written out."""
        for v in self._below(lambda v: v.summary is not None):
            v._summarize(text)
        length, counts, head, tail, quoted = self.summary
        if length <= _ENDS:
            return literal_score(head, quoted)
        # the ends and every character once between them match PLACEHOLDER as the value does
        return -1.0 if PLACEHOLDER.match(head + "".join(counts) + tail) else _character_score(length, counts, quoted)

    def report(self) -> list[Piece]:
        """Pieces that no value has reported yet."""
        out = []
        for v in self._below(lambda v: v.reported):
            v.reported = True
            out += [p for p in v.parts if not isinstance(p, Value)]
        return out


class BareRun:
    """The run of bare characters around the last position asked for, and its characters counted
    from one position on.  Positions mostly grow, so a run with many operators is read once."""

    __slots__ = ("start", "end", "counted", "counts")

    def __init__(self) -> None:
        self.start = self.end = self.counted = 0
        self.counts: Counter = Counter()

    def value(self, text: str, at: int) -> Value | None:
        """The bare value that starts at ``at``."""
        if not self.start <= at < self.end:
            m = _BARE.match(text, at)
            if not m:
                return None
            self.start = self.counted = at
            self.end, self.counts = m.end(), Counter()
        return Value([(at, self.end, False)], self)

    def characters(self, text: str, start: int, end: int) -> Counter:
        """Counts of the characters of a value of this run, or of an earlier one."""
        if end != self.end or start < self.counted:
            return Counter(text[start:end])
        if self.counts:
            self.counts.subtract(text[self.counted : start])
        else:
            self.counts = Counter(text[start:end])
        self.counted = start
        return +self.counts


def _expression(text: str, at: int, known: dict[str, Value], chains: dict[int, Value], run: BareRun) -> Value:
    """Literals of the expression that starts at ``at``, identifiers replaced by their values.
    ``chains`` gets the value for the start of every further target of a chain."""
    starts = []
    while (
        (m := _IDENTIFIER.match(text, _past_blanks(text, at)))
        and m[0] not in known
        and (chained := _CHAINED.match(text, m.end()))
    ):
        at = chained.end()
        starts.append(at)
    value = _value(text, at, known, run)
    chains.update((k, value) for k in starts)
    return value


def _past_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANKS:
        at += 1
    return at


def _value(text: str, at: int, known: dict[str, Value], run: BareRun) -> Value:
    pieces: list[Piece | Value] = []
    first = True
    while True:
        while at < len(text) and text[at] in _BLANKS:
            at += 1
        if m := _QUOTED.match(text, at):
            k = m.lastindex
            pieces.append((m.start(k), m.end(k), True))
            at = m.end()
        elif (m := _IDENTIFIER.match(text, at)) and (value := known.get(m[0])) is not None:
            pieces.append(value)
            at = m.end()
        elif first and (value := run.value(text, at)) is not None:
            return value
        else:
            return Value(pieces)
        first = False
        while at < len(text) and text[at] in _BLANKS:
            at += 1
        if at < len(text) and text[at] in "+.":
            at += 1
        elif not (at < len(text) and text[at] in "\"'`"):
            return Value(pieces)


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of every assignment in order, constants propagated as shared values."""
    known: dict[str, Value] = {}
    chains: dict[int, Value] = {}
    run = BareRun()
    skip = line = seen = 0
    for m in _OPERATOR.finditer(text):
        if m.start() < skip:
            continue
        end = _operator(text, m.start())
        if end < 0:
            continue
        skip = end
        line = max(line, text.rfind("\n", seen, m.start()) + 1)
        seen = m.start()
        name = _name_before(text, m.start(), line)
        if not name:
            continue
        value = chains.pop(end, None) or _expression(text, end, known, chains, run)
        if value.parts:
            known[name] = value
            yield name, value
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m[1], Value([(m.start(2), m.end(2), True)])


def literal_spans(text: str) -> list[Span]:
    """Literals assigned to sensitive names."""
    out = set()
    for name, value in assignments(text):
        score = name_score(name)
        if score <= 0:
            continue
        if score + value.score(text) >= THRESHOLD:
            out.update(("literal", a, b) for a, b, _ in value.report() if b > a)
    return sorted(out, key=lambda s: s[1:])


def _outside(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that lie inside no base span; both lists are in order of their starts."""
    out = []
    k = reach = 0
    for s in spans:
        while k < len(base) and base[k][1] <= s[1]:
            reach = max(reach, base[k][2])
            k += 1
        if s[2] > reach:
            out.append(s)
    return out


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind; a literal inside a base span adds
    nothing and is left out."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    more = []
    if _OPERATOR.search(text) or "</" in text:
        more = _outside(literal_spans(text), base)
    return base, sorted(base + more, key=order)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(s[1:] for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_assign, n_access, n_hex, n_literal, base_spans, spans)."""
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                rows = []
                for t in texts:
                    base, spans = find_spans(t)
                    n = Counter(s[0] for s in spans)
                    rows.append((*(n[k] for k in KINDS), join_spans(base), join_spans(spans)))
                cols = [batch.column("id").slice(lo, len(texts))]
                cols += [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
                cols += [pa.array(c, pa.string()) for c in list(zip(*rows))[4:]]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "n_assign", "n_access", "n_hex", "n_literal", "base_spans", "spans"]
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_spans string, spans string"
    ).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All documents, in the input's columns, every secret replaced by ``[SECRET]``; n_chars
    (where present) follows the text."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            n_at = batch.schema.get_field_index("n_chars")
            for lo, texts in text_slices(batch.column(at)):
                cols = [c.slice(lo, len(texts)) for c in batch.columns]
                new = [redact(t, find_spans(t)[1]) for t in texts]
                old = cols[at].is_null().to_pylist()
                cols[at] = pa.array([None if null else t for null, t in zip(old, new)], cols[at].type)
                if n_at >= 0:
                    was = cols[n_at].to_pylist()
                    cols[n_at] = pa.array(
                        [len(t) if t != s else n for t, s, n in zip(new, texts, was)], cols[n_at].type
                    )
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
