"""Queries travel once to a group of neighbouring cells, and pairs stay those of brute force, ties included."""

from __future__ import annotations

import uuid

import numpy as np

from siltstone.operators.vector_index import VectorIndex
from siltstone.sources.scratch import shared_folder


def test_pairs_by_groups_of_cells(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(600, 8))
    x[500:540] = x[7]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = VectorIndex.build(rows, f"{shared_folder(spark)}/{uuid.uuid4().hex}", cell=8, fan=8, sample=600)
    sent, tiles = [], VectorIndex._tiles
    monkeypatch.setattr(VectorIndex, "_tiles", lambda self, queries, visits, *more: (sent.append(visits.count()), tiles(self, queries, visits, *more))[1])
    found = {(r.a, r.b) for r in index.pairs(0.2, 4).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(u @ u.T, 12)
    np.fill_diagonal(score, -np.inf)
    near = [sorted(range(600), key=lambda b: (-score[a, b], b))[:3] for a in range(600)]
    assert found == {(min(a, b), max(a, b)) for a in range(600) for b in near[a] if score[a, b] >= 0.2}
    assert sum(sent) <= 600 * 12 < 600 * index.nodes.where("leaf").count()
