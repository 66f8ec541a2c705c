"""Blocks of vectors meet once for both sides, copies are compared as one, and pairs stay those of brute force."""

from __future__ import annotations

import uuid

import numpy as np
import pytest

from siltstone.operators import vector_index
from siltstone.operators.vector_index import VectorIndex
from siltstone.sources.scratch import shared_folder


def brute(x, ids, least, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(u @ u.T, 12)
    np.fill_diagonal(score, -np.inf)
    near = [sorted(np.flatnonzero(row >= least), key=lambda b: (-row[b], ids[b]))[:k] for row in score]
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])): score[a, b] for a, own in enumerate(near) for b in own}


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_pairs_by_blocks(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(20, 8)), 20, axis=0) + x * 0.01
    x[300:340] = x[7]
    ids = [f"v{(i * 37) % 400:03d}" for i in range(400)]
    for name, value in (("CHUNK", 8), ("CHUNKS", 2), ("BLOCK", 8 * 8 * 8 * 4), ("HELD", 500)):
        monkeypatch.setattr(vector_index, name, value)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, embedding array<double>")
    index = VectorIndex.build(rows, f"{shared_folder(spark)}/{uuid.uuid4().hex}", cell=16, fan=8, sample=400)
    sent, compared, tiles, heads = [], [], VectorIndex._tiles, VectorIndex._near_heads
    monkeypatch.setattr(VectorIndex, "_tiles", lambda self, sides, met, *more: (sent.extend(met.collect()), tiles(self, sides, met, *more))[1])
    monkeypatch.setattr(VectorIndex, "_near_heads", lambda self, all_, *more: (compared.append(all_.count()), heads(self, all_, *more))[1])
    found = {(r.a, r.b): r.score for r in index.pairs(0.2, 5).collect()}
    assert found == pytest.approx(brute(x, ids, 0.2, 4), abs=1e-11)
    blocks = len({r.i for r in sent} | {r.j for r in sent})
    assert compared == [360] and all(r.i < r.j and r.chunk // 4 in (r.i, r.j) for r in sent)
    assert len(sent) <= 45 * (blocks - 1) and (kind == "random" or len(sent) < 45 * (blocks - 1) / 2)


def test_single_precision_hides_no_order():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(1, 6)) + rng.normal(size=(60, 6)) * s for s in (1e-3, 1e-5)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    at, rank = [slice(i, i + 20) for i in range(0, 120, 20)], rng.permutation(120)
    rounds = [[(p, p) for p in at], [(p, q) for i, p in enumerate(at) for q in at[i + 1 :]]]
    a, b, score = vector_index._nearest_rows(x, rank, rounds, np.full(120, -1.0), 3)
    want = np.round(x @ x.T, 12)
    np.fill_diagonal(want, -np.inf)
    got = [want[i, b[a == i]].tolist() for i in range(120)]
    assert got == [sorted(row, reverse=True)[:3] for row in want.tolist()] and (score == want[a, b]).all()
