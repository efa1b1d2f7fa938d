"""Embedding near-duplicates against all cosines; estimates and bounds of the codes."""

from __future__ import annotations

import math

import numpy as np
import pytest

from orderlens.llm import embedding_dedup as ed
from orderlens.llm import queries


def plain(rows, cosine=0.95):
    """(id, n_links, component, kept) of (id, vector) rows."""

    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    label = list(range(len(rows)))
    links = [0] * len(rows)
    by_dim: dict = {}
    for i, (_, v) in enumerate(rows):
        if fine(v):
            by_dim.setdefault(len(v), []).append(i)
    for at in by_dim.values():
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = x @ x.T >= cosine
        for a, b in zip(*np.nonzero(np.triu(close, 1))):
            links[at[a]] += 1
            links[at[b]] += 1
            old, new = label[at[b]], label[at[a]]
            if old != new:
                label = [new if k == old else k for k in label]
    out = []
    for i, (vec_id, v) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, links[i], component, vec_id is not None and vec_id == component))
    return sorted(out, key=repr)


def results(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def near(rng, center, cosine):
    """A unit vector at the given cosine to ``center``."""
    noise = rng.normal(size=len(center))
    noise -= noise @ center * center
    return cosine * center + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


def unit(rng, dim):
    x = rng.normal(size=dim)
    return x / np.linalg.norm(x)


def test_rotation_keeps_inner_products_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x = np.array([unit(rng, 48) for _ in range(60)])
    turned = ed.rotate(x, 3)
    assert np.allclose(turned @ turned.T, x @ x.T)
    o = unit(rng, 48)
    q = near(rng, o, 0.9)
    found = []
    old = ed.SEED
    try:
        for seed in range(600):
            ed.SEED = seed
            ed._signs.cache_clear()
            codes, factors = ed.encode(o[None])
            found.append(float(ed.estimates(codes, factors, ed.rotate(q[None], 0))[0, 0]))
    finally:
        ed.SEED = old
        ed._signs.cache_clear()
    spread = math.sqrt(1 - 0.9**2) * math.sqrt((1 - 0.8**2) / 0.8**2 / 127)
    assert abs(np.mean(found) - 0.9) < 4 * spread / math.sqrt(len(found))
    assert 0.7 * spread < np.std(found) < 1.3 * spread


@pytest.mark.parametrize("dim", [8, 64, 1024])
def test_bounds_decide_pairs_as_the_exact_cosine_does(dim):
    rng = np.random.default_rng(dim)
    base = [unit(rng, dim) for _ in range(12)]
    x = np.array([near(rng, b, c) for b in base for c in rng.uniform(0.9, 1, 12)] + [unit(rng, dim) for _ in range(60)])
    codes, factors = ed.encode(x)
    forest = ed.Forest(len(x))
    counts = ed.compare(x, codes, factors, np.ones(len(x), dtype=np.int64), len(x), forest, 0.95)
    close = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert counts.tolist() == close.sum(axis=1).tolist()
    refuse, accept = ed.confidence(factors, ed.code_bits(dim), 0.95)
    found = ed.estimates(codes, factors, ed.rotate(x, 0))
    upper = np.triu(np.ones_like(close), 1)
    assert not (close & (found < refuse[:, None])).any() and not (~close & upper & (found > accept[:, None])).any()
    # most pairs of unlike vectors need no exact cosine; long codes also accept
    assert (found < refuse[:, None])[~close].mean() > 0.5
    if dim == 1024:
        assert (found > accept[:, None])[close].any()


@pytest.mark.parametrize("cell_rows,tile,bucket", [(16_384, 4096, 512), (40, 16, 512), (25, 7, 16)])
def test_equals_all_cosines(spark, monkeypatch, cell_rows, tile, bucket):
    """Copies, multiples, chains, a hot group, unusable vectors, null and repeated ids, two lengths."""
    monkeypatch.setattr(ed, "BUCKET", bucket)
    rng = np.random.default_rng(tile)
    vectors = [unit(rng, 32) for _ in range(150)]
    for _ in range(40):
        vectors.append(near(rng, vectors[rng.integers(0, 100)], rng.uniform(0.93, 0.9999)))
    vectors += [near(rng, vectors[0], 0.985) for _ in range(90)]
    chain = [vectors[1]]
    for _ in range(20):
        chain.append(near(rng, chain[-1], 0.96))
    vectors += chain + [vectors[2]] * 30 + [3 * vectors[2], 1e200 * vectors[3], 1e-200 * vectors[3]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] + [1.0] * 31), (904, [float("inf")] * 32)]
    rows += [(905, [None] + [1.0] * 31), (None, rows[0][1]), (None, [0.5] * 32), (None, None), (3, rows[5][1]), (3, rows[5][1])]
    rows += [(910 + j, [float(x) for x in near(rng, np.ones(5) / math.sqrt(5), 0.99)]) for j in range(6)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, root string")
    got = results(ed.near_vectors(frame.repartition(4), cell_rows=cell_rows, tile=tile))
    assert got == plain(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_vectors(empty).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert results(queries.op11_embedding_dedup(spark, sf)) == plain(rows)


def test_bands_and_codes_keep_pairs_at_the_limit():
    rng = np.random.default_rng(9)
    for n in (50_000, 10**9):
        k, bands = ed.band_plan(n, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** k) ** bands <= ed.MISS
    a = np.array([unit(rng, 64) for _ in range(2000)])
    b = np.array([near(rng, x, 0.9501) for x in a])
    ca, cb = ed.encode(a)[0], ed.encode(b)[0]
    apart = np.unpackbits(ca ^ cb, axis=1).sum(axis=1)
    assert apart.max() <= ed.most_bits(128, 0.95) and ed.most_bits(128, 0.95) < 40
