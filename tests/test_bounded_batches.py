"""What a Python task passes on at once is bounded, whatever its input."""

from __future__ import annotations

import random

import pyarrow as pa

from siltstone.operators import trigram_index


def test_postings_come_in_small_batches_and_are_whole():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for _ in range(300)]
    given = pa.RecordBatch.from_pydict({"id": list(range(300)), "title": [["abc"]] * 300, "said": texts})
    found = list(trigram_index._postings(5000, pa.int64())(iter([given])))
    assert max(b.num_rows for b in found) <= 10_000 < sum(b.num_rows for b in found)
    got: dict = {}
    for b in found:
        for r in b.to_pylist():
            if r["kind"] == "text":
                got.setdefault(r["id"], set()).update(r["joined"][i : i + 3] for i in range(0, len(r["joined"]), 3))
    assert got == {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in enumerate(texts)}
