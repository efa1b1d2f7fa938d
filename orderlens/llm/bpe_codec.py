"""BPE encoding and decoding with a merge queue over a linked symbol list.

A word starts as a doubly linked list of symbols.  A heap holds the possible merges of
neighbours by (merge rank, position).  The best one is applied, its two new neighbour pairs
are pushed, and entries whose symbols have changed meanwhile are skipped when they come up.
Decoding concatenates vocabulary strings; this file format has no decoder, so the library
joins the strings of tokens by one space.

Words are found as the file says: special strings first, in the raw text; then its
normalization (NFC, white space to a blank, lower case) and its split pattern; then bytes as
printable characters with ``</w>`` at the word's end.  None of these steps crosses white
space, so results of short pieces and words are kept in a cache per worker, bounded in entries
and in characters an entry, frequent ones longest; the document's digest is joined from them.

Defined results: a null text is empty (no ids, digest of the empty string); rows are
handled one by one, so repeated rows and null or repeated ids give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.tokens import byte_characters, load_tokenizer, text_slices

CACHE_ENTRIES = 250_000
# Longer pieces (text without blanks) are encoded each time, so the caches stay small in bytes too.
CACHED_CHARS = 64
# A heap entry is one number: a merge's rank above a place in the word.
PLACE_BITS = 32
_PLACE = (1 << PLACE_BITS) - 1
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Cache(dict):
    """Results of ``make`` for short strings, bounded, in two generations: entries that were not
    asked for while ``entries`` others came are forgotten, so frequent ones stay."""

    def __init__(self, entries: int, make):
        super().__init__()
        self.entries, self.make = entries, make
        self.old: dict = {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class BpeCodec:
    """Encoder and decoder of a word-level BPE file with a word-end suffix."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        vocab = self.vocab
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # a pair of neighbours is one number; its merge is the rank, shifted to make room for a place
        self.merges: dict[int, int] = {}
        self.merged: list[int] = []
        for r, (a, b) in enumerate(pairs):
            self.merges[vocab[a] << 20 | vocab[b]] = r << PLACE_BITS
            self.merged.append(vocab[a + b])
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self._decimals = {i: str(i) for i in self.strings}
        names = sorted(self.special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(split)
        self._normalize = load_tokenizer(path).normalizer.normalize_str
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        # NFC leaves ASCII as it is, so printable ASCII without blanks is only lower-cased
        self._ascii_lower = steps == ["NFC", "Replace", "Lowercase"]
        self._bytes = [vocab[c] for c in byte_characters()]
        self._last = [vocab[c + self.suffix] for c in byte_characters()]
        self._pieces = Cache(cache_entries, self._piece)
        self._words = Cache(cache_entries, self._word)

    def merge_word(self, symbols: list[int]) -> list[int]:
        """Apply merges, best rank first and leftmost among equals, until none applies."""
        find, pop, push = self.merges.get, heapq.heappop, heapq.heappush
        # the entry that holds for each place and its neighbour, without the place
        now = [find(a << 20 | b) for a, b in zip(symbols, symbols[1:])]
        heap = [m | i for i, m in enumerate(now) if m is not None]
        if not heap:
            return symbols
        heapq.heapify(heap)
        now.append(None)
        n, merged_ids = len(symbols), self.merged
        sym = list(symbols)
        prev = list(range(-1, n - 1))
        nxt = [*range(1, n), -1]
        while heap:
            entry = pop(heap)
            i = entry & _PLACE
            if now[i] != entry ^ i:
                continue  # stale: one of the two has been merged since
            j = nxt[i]
            sym[i] = merged = merged_ids[entry >> PLACE_BITS]
            sym[j], now[i], now[j] = -1, None, None
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                m = now[i] = find(merged << 20 | sym[k])
                if m is not None:
                    push(heap, m | i)
            h = prev[i]
            if h >= 0:
                m = now[h] = find(sym[h] << 20 | merged)
                if m is not None:
                    push(heap, m | h)
        return [x for x in sym if x >= 0]

    def _word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded text) of a word."""
        raw = word.encode("utf-8")
        of_byte = self._bytes
        symbols = [of_byte[b] for b in raw]
        symbols[-1] = self._last[raw[-1]]
        ids = self.merge_word(symbols)
        return len(ids), " ".join([self._decimals[i] for i in ids]), self.decode(ids)

    def _plain_words(self, text: str) -> list[tuple[int, str, str]]:
        """:meth:`_word` for every word of a text without special strings."""
        if self._ascii_lower and text.isascii() and text.isprintable() and " " not in text:
            text = text.lower()
        else:
            text = self._normalize(text)
        return list(map(self._words.__getitem__, self._split.findall(text)))

    def _all_words(self, text: str) -> list[tuple[int, str, str]]:
        """:meth:`_plain_words`, special strings in the text as words of one id."""
        if self._specials is None:
            return self._plain_words(text)
        parts = self._specials.split(text)
        if len(parts) == 1:
            return self._plain_words(text)
        words = []
        for part in parts:
            if part in self.special:
                i = self.special[part]
                words.append((1, str(i), self.strings[i]))
            elif part:
                words += self._plain_words(part)
        return words

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special strings in it as their own ids."""
        return [int(i) for _, ids, _ in self._all_words(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def _piece(self, piece: str) -> tuple[int, str, str]:
        words = self._all_words(piece)
        return words[0] if len(words) == 1 else _joined(words)

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded text) of a whole text."""
        pieces = [text] if _SEPARATORS.search(text) else text.split()
        return _joined([got for got in map(self._pieces.__getitem__, pieces) if got[0]])


def _joined(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    if not parts:
        return 0, "", ""
    n, ids, decoded = zip(*parts)
    return sum(n), " ".join(ids), " ".join(decoded)


@contextmanager
def _uncollected():
    """No cyclic garbage collection inside: it would walk the caches, which hold no cycles, again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """One row per input row: (id, n_tokens, ids, decoded), ids as decimals joined by blanks.
    ``digests`` returns SHA-256 digests of the two strings instead of them."""
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches):
        from hashlib import sha256

        c = codec(tokenizer_path)
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                with _uncollected():
                    rows = [c.round_trip(t) for t in texts]
                if digests:
                    rows = [(n, sha256(a.encode()).hexdigest(), sha256(b.encode()).hexdigest()) for n, a, b in rows]
                n, ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["id", "n_tokens", *names],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, {names[0]} string, {names[1]} string").withColumnRenamed(
        "id", id_col
    )
