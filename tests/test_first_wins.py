"""Greedy first-wins by rounds against the loop: random graphs, chains, hubs, and batches and clusters of any size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ingest
from siltstone.operators.first_wins import first_wins


def loop(order, near):
    kept, leader = [], {}
    for i in order:
        leader[i] = next((k for k in kept if k in near.get(i, ())), i)
        if leader[i] == i:
            kept.append(i)
    return leader


def graphs():
    draw = random.Random(1)
    yield "random", [(draw.randrange(90), draw.randrange(90)) for _ in range(160)], 90
    yield "chain", [(i, i + 1) for i in range(69)], 70
    yield "backwards", [(i + 1, i) for i in range(69)], 70
    yield "first is a hub", [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)], 60
    yield "last is a hub", [(59, i) for i in range(59)], 60
    yield "no pairs", [], 5
    yield "itself, twice", [(1, 1), (1, 2), (2, 1), (1, 2)], 4


@pytest.mark.parametrize("name, links, n", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_equal_to_the_loop(spark, name, links, n):
    near: dict[int, set[int]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    place = list(range(n))
    if name == "random":
        random.Random(2).shuffle(place)
    rows = spark.createDataFrame([(i, place[i]) for i in range(n)], "id long, place long")
    kind = "a struct<id: bigint>, b struct<id: bigint>"
    pairs = spark.createDataFrame([((a,), (b,)) for a, b in links], kind)
    got = first_wins(rows, pairs, ["id"], [F.col("place")], block=16)
    assert {r.id: r.leader.id for r in got.collect()} == loop(sorted(range(n), key=place.__getitem__), near)


def test_clusters_equal_the_loop(spark):
    draw = random.Random(4)
    angle = [draw.random() * 3 for _ in range(70)]
    import math

    unit = lambda t: [math.cos(t), math.sin(t)]
    rows = [(i * 7 % 70, i, unit(t) if i % 9 else None) for i, t in enumerate(angle)]
    near = {i: {j for j in range(70) if i % 9 and j % 9 and math.cos(angle[i] - angle[j]) >= 0.95} for i in range(70)}
    found = ingest.clustered(spark.createDataFrame(rows, "rank long, id long, unit array<double>"), 0.95, tile=16)
    assert {r.id: r.leader for r in found.collect()} == loop([r[1] for r in sorted(rows)], near)
