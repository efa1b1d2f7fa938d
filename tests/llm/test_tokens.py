"""Token counts, packing and ORC token files against the tokenizers library."""

from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import queries
from orderlens.llm.orc_tokens import read_token_orc, write_token_orc
from orderlens.llm.token_counts import count_tokens
from orderlens.llm.tokens import TextEncoder, load_tokenizer, text_encoder
from orderlens.llm.vector_packing import Limits, VectorPacker, pack_documents, pack_examples

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = load_tokenizer(PATH)
EDGE = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\n c\t\td "), (5, "x<|endoftext|>y <|endoftext|> z"),
    (6, "it's we'll  they've n b"), (7, "a\x1cb !\x1d \x1e"), (8, "word " * 5000), (9, "x" * 3000),
    (9, "x" * 3000), (12, "y" * 60000 + " z"), (None, "null id"), (10, "日本語テキスト " * 400 + "🙂" * 500), (11, "<|endof" * 300 + "<|endoftext|>" * 300),
]


def ref(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(
        [(i, t, "clash", 7) for i, t in EDGE], "doc_id long, text string, n_tokens string, ids int"
    )


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sT1 \n\t \u3000\x1c\x85é!<|>日"), max_size=40))
def test_encoder_equals_library(text):
    enc = text_encoder(PATH)
    assert np.frombuffer(enc.encode([text])[0], dtype="<u4").tolist() == ref(text)
    assert enc.count([text]) == [len(ref(text))]


def test_engine_is_proven_and_agrees_over_code_points():
    enc = text_encoder(PATH)
    assert enc.engine is not None
    texts = [f"a{c}b 1{c}2 {c}{c} !{c}?\n{c} x" for c in map(chr, [*range(0x300), *range(0x300, 0xD800, 37), *range(0x10000, 0x20000, 101)])]
    want = [e.ids for e in TOK.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want


def test_engine_is_refused_without_proof(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc = TextEncoder(str(tmp_path / "t.json"))
    assert enc.engine is None
    assert np.frombuffer(enc.encode(["ABC Def"])[0], "<u4").tolist() == ref("abc def")


def test_counts_with_tiny_windows(spark, edge):
    rows = count_tokens(edge, PATH, chunk_chars=256, overlap=64).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    want = sorted((str(i), len((t or "").encode()), len(ref(t)), len(ref(t)) > 1024) for i, t in EDGE)
    assert got == want
    assert max(r.n_windows for r in rows) > 10


def test_counts_empty_table(spark, edge):
    assert count_tokens(edge.limit(0), PATH).collect() == []


def test_op1_equals_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, t in docs.items():
        assert (got[k].n_bytes, got[k].n_tokens) == (len((t or "").encode()), len(ref(t)))


def check_pieces(rows, ids_of, max_tokens=1024, max_segments=256):
    """Each id in exactly one piece; sequences gapless; returns the padding share."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert docs.keys() == ids_of.keys()
    for k, parts in docs.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids_of[k])
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[k][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids_of[k])
    pad = total = 0
    for parts in seqs.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= max_tokens and len(parts) <= max_segments
        total += at
        pad += 0 if at & (at - 1) == 0 else max_tokens - at
    return pad / max(total, 1)


def test_op2_packs_every_id_once(spark):
    ids = {r.doc_id: ref(r.text) + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_pieces(queries.op2_vector_packing(spark, SF).collect(), ids) < 0.005


def test_packing_edge_rows_and_empty_table(spark, edge):
    rows = pack_documents(edge, PATH, 0).collect()
    assert sum(r.length for r in rows) == sum(len(ref(t)) + 1 for _, t in EDGE)
    assert pack_documents(edge.limit(0), PATH, 0).collect() == []


def test_three_limits_hold_without_cutting(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(1500):
        n = int(rng.integers(1, 50))
        data.append((i, list(range(n)), [bool(b) for b in rng.random(n) < rng.random()]))
    data += [(2000, [], []), (2001, None, None), (2002, [5], None)]
    df = spark.createDataFrame(data, "conv long, ids array<int>, loss array<boolean>").repartition(3, "conv")
    lim = Limits(tokens=128, segments=6, loss=50, cut=False, pool=64)
    rows = pack_examples(df, "conv", "ids", "loss", lim).collect()
    assert sorted(r.conv for r in rows) == sorted(i for i, ids, _ in data if ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        assert sum(p.length for p in parts) <= 128 and len(parts) <= 6 and sum(p.n_loss for p in parts) <= 50
    bound = max(sum(r.length for r in rows) / 128, len(rows) / 6, sum(r.n_loss for r in rows) / 50)
    assert len(seqs) <= 1.25 * bound + 3


def test_cut_respects_loss_limit():
    lim = Limits(tokens=64, segments=4, loss=20, cut=True, min_piece=1, pool=8)
    p, out = VectorPacker(lim), []
    rng = np.random.default_rng(1)
    for i in range(40):
        n = int(rng.integers(1, 200))
        out += list(p.add(i, np.arange(n, dtype="<u4"), rng.random(n) < 0.6))
    out += list(p.finish())
    seqs = {}
    for doc, start, ids, total, loss, seq, off in out:
        s = seqs.setdefault(seq, [0, 0, 0])
        assert off == s[0]
        s[0] += len(ids); s[1] += 1; s[2] += loss  # noqa: E702
    assert all(a <= 64 and b <= 4 and c <= 20 for a, b, c in seqs.values())


def test_overlong_example_raises_without_cutting():
    with pytest.raises(ValueError):
        list(VectorPacker(Limits(cut=False)).add(1, np.zeros(2000, "<u4"), np.ones(2000, bool)))


def test_op8_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op8_orc_tokens(spark, SF).collect()}
    at = 0
    for d in docs:
        ids = ref(d.text) + [2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert len(got) == len(docs)


def test_orc_files_edges_lookup_and_layout(spark, edge, tmp_path):
    path = write_token_orc(edge, str(tmp_path / "t.orc"), PATH, 2)
    rows = sorted(read_token_orc(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows[:-1]]))
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert ids == sorted(ids) and len(rows) == len(EDGE)
    assert [r.ids for r in read_token_orc(spark, path).filter("doc_id = 5").collect()] == [ref(EDGE[4][1]) + [2]]
    plan = read_token_orc(spark, path).filter("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan
    from pyarrow import orc

    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert files and orc.ORCFile(f"{path}/{files[0]}").nstripes >= 1
    empty = write_token_orc(edge.limit(0), str(tmp_path / "e.orc"), PATH, 2)
    assert read_token_orc(spark, empty).collect() == []
