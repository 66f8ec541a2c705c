"""Likeness within a batch of several blocks, against brute force."""

from __future__ import annotations

import random

from siltstone.operators import ingest


def test_a_batch_of_several_blocks_equals_brute_force(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(b, i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for b, n in ((0, 1), (1, 6), (2, 60)) for i in range(n)]
    df = spark.createDataFrame([*rows, (2, 900, None), (2, None, "alpha"), (None, 1, "alpha"), (None, 2, "alpha")], "batch long, id long, text string")
    grams = {(b, i): {t[k : k + 2] for k in range(len(t) - 1)} if len(t) > 1 else {t} for b, i, t in rows}
    likeness = {(a[0], a[1], b[1]): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a[0] == b[0] and a[1] < b[1]}
    want = {k: v for k, v in likeness.items() if v >= 0.35}
    found = ingest.alike_in_batch(df, 0.35, block=7).collect()
    assert len(found) == len(want)
    assert {(r.batch, r.a, r.b): r.likeness for r in found} == want
