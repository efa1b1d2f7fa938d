"""Encoding whole texts with a public tokenizer file, fast enough for whole corpora.

The tokenizers library encodes about 1 MB a second and core.  The same file also drives
tiktoken's engine, which is several times faster, and whose ids are proven equal when

* every vocabulary string encodes to itself in the library.  A merge engine that joins any
  two neighbours whose bytes stand in the vocabulary could differ from one that follows the
  merge list only at a pair that the list joins in another way; on that string alone the
  list's merges run in the same order, so they would reach the same pair;
* ids follow the order of merges, so the lowest id is the best merge;
* the file has nothing that tiktoken lacks: plain byte-level pre-tokenization, no
  normalizer, special strings without stripping.

:func:`text_encoder` checks this when it loads a file (0.2 s per worker) and falls back to
the library's own encoder where it does not hold.  Both split by the same pattern; that they agree
on every code point in every position was checked once, and the tests repeat it in part.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

# Fixed value: the split pattern of byte-level pre-tokenization.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A word this long goes to the library, whose merge queue handles any length well.
_HUGE_WORD = re.compile(r"\S{20000}")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file; one per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, the
    next code point from 256 on otherwise."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _plain_byte_level(spec: dict) -> bool:
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    return (
        spec["normalizer"] is None
        and spec["post_processor"] is None
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, or their counts."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.engine = self._engine(path)

    def _engine(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _plain_byte_level(spec):
            return None
        of_char = {c: b for b, c in enumerate(byte_characters())}
        vocab, model = spec["model"]["vocab"], self.tokenizer.model
        ranks = {bytes(of_char[c] for c in token): i for token, i in vocab.items()}
        if any([t.id for t in model.tokenize(token)] != [i] for token, i in vocab.items()):
            return None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        ids = [vocab[a + b] for a, b in pairs]
        if any(a >= b for a, b in zip(ids, ids[1:])):
            return None
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        out = []
        for text in texts:
            if self.engine is None or len(text) >= 20_000 and _HUGE_WORD.search(text):
                ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            else:
                ids = self.engine.encode_to_numpy(text, allowed_special="all")
            out.append(np.asarray(ids, dtype="<u4").tobytes())
        return out

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.encode(texts)]


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """The worker's encoder for a file."""
    return TextEncoder(path)


def text_slices(column, rows: int = 256):
    """Lists of at most ``rows`` texts of an Arrow column, null as the empty text."""
    for lo in range(0, len(column), rows):
        yield lo, [t or "" for t in column.slice(lo, rows).to_pylist()]
