"""Ranked lexical search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from orderlens.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 10 + (90 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(words(text)) & set(c)
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def random_text(rng, n):
    # a few very common words, many rare ones
    return " ".join(rng.choice(["the", "The", "of", "Été", "x1"]) if rng.random() < 0.6 else f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(n))


def test_terms():
    text = "A-b_C9 éÉ\x00ß\x7f漢字 x　y Ünï"
    assert [t.decode() for t in ls.terms_of(text)] == words(text)
    assert ls.terms_of(None) == ls.terms_of(" .\n") == []


@pytest.mark.parametrize("shard_docs,window,short,block", [(65_536, 8192, 0.25, 10**6), (40, 7, 0.0, 10), (64, 16, 0.05, 60), (90, 90, 9.0, 25)])
def test_equals_scoring_every_document(spark, monkeypatch, shard_docs, window, short, block):
    """Nulls, copies that tie, repeated rows and ids, empty and very long texts, any split."""
    rng = random.Random(shard_docs)
    monkeypatch.setattr(ls, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ls, "WINDOW_DOCS", window)
    monkeypatch.setattr(ls, "SHORT_SHARE", short)
    texts = [random_text(rng, rng.randrange(1, 40)) for _ in range(300)] + ["", None, " .. ", random_text(rng, 20_000)]
    texts += [texts[0]] * 60 + [texts[5]] * 3
    docs = list(enumerate(texts)) + [(7, texts[7]), (8, "other w3 the"), (None, texts[0]), (None, "w3 w4")]
    items = [(j, random_text(rng, rng.randrange(1, 30))) for j in range(15)]
    items += [(3, "w3 the"), (3, "w3 the"), (50, None), (51, "?!"), (None, "w4 W3 of"), (52, texts[0]), (53, "nowhere")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, q int, n int").repartition(3)
    t = spark.createDataFrame([(*r, "a") for r in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in ls.rank_documents(d, t, 10, block_terms=block).collect()]
    assert sorted(got, key=repr) == plain(docs, items, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert ls.rank_documents(docs.limit(0), items).collect() == []
    assert ls.rank_documents(docs, items.limit(0)).collect() == []


def test_lists_below_the_threshold_are_skipped():
    """A long list with a low bound is not read when the accumulators already hold k better ones."""
    n = 5000
    weights = np.array([10, 9000], dtype=np.int64)
    terms = np.concatenate([np.zeros(n), np.ones(20)]).astype(np.int32)
    docs = np.concatenate([np.arange(n), np.arange(100, 120)])
    by = np.argsort(docs, kind="stable")
    ends = np.searchsorted(docs[by], np.arange(n + 1))
    shard = ls.Shard(list(range(n)), np.full(n, 30), ends, terms[by], np.ones(len(by), dtype=np.int64), weights, n, 30 * n)
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            reads.append(key)
            return super().__getitem__(key)

    lists = shard.lists

    def watched(query):
        return [(d, s.view(Watched) if len(d) == n else s, b) for d, s, b in lists(query)]

    shard.lists = watched
    place, score = ls.evaluate(shard, np.array([0, 1], dtype=np.int32), 10, 1)
    assert place.tolist() == list(range(100, 110)) and len(set(score.tolist())) == 1
    assert all(not isinstance(key, slice) for key in reads)  # probed, never walked
