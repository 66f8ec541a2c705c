"""Vector codes, ranked search and repeated passages: brute force, ties, awkward rows and hot groups."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import codes, ranking, repeats, suffixes
from siltstone.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "searches")


@pytest.mark.parametrize("n, span", [(1, 3), (9, 2), (300, 2), (256, 50), (200, 10**6)])
def test_tree_finds_the_lowest_nearest(n, span):
    rng = np.random.default_rng(n)
    entries, q = rng.integers(-span, span, (n, 5)), rng.integers(-span, span, (400, 5))
    d = ((q[:, None, :] - entries) ** 2).sum(axis=2)
    index, best = codes.KdTree(entries).nearest(q)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """By the rules, over (vec_id, integers) of equal length, in the order of their ids."""
    x = np.array([r[1] for r in rows], dtype=object).reshape(len(rows), parts, -1)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def assigned():
        near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
        return [[near(v[p], books[p]) for p in range(parts)] for v in x]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, f in zip(x, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    return {r[0]: ("".join(f"{f[1]:02x}" for f in found), sum(f[0] for f in found)) for r, found in zip(rows, assigned())}


def test_codes_equal_brute_force(spark, scratch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(340, 8)), 1)
    rows = [(i, [float(v) for v in r], i % 3 if i % 7 else None) for i, r in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("CODE", F.lit(1))
    coded, books = codes.compressed(vectors, scratch)
    want = brute_codes([(i, [math.floor(1024 * v) for v in r]) for i, r, _ in rows])
    got = coded.collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    for label in (0, 1, 2, None):
        total = sum(want[i][1] for i, _, c in rows if c == label)
        assert {r.label_error for r in got if r.label == label} == {total}
    assert len(books.sha256()) == 64
    named, _ = codes.with_codes(vectors, scratch)
    assert named.columns == ["vec_id", "embedding", "label", "code"] and {r.vec_id: r.code for r in named.collect()} == {i: w[0] for i, w in want.items()}


def test_codes_on_awkward_rows(spark, scratch):
    """Unusable vectors are left out; short and empty ones are filled up with zeros; huge components are held."""
    rows = [(3, [1.0, 2.0, 3.0, 4.0, 5.0], "a"), (1, [], "a"), (2, None, "a"), (4, [None, 1.0], "b"), (5, [math.nan], None),
            (6, [math.inf, 0.0], None), (None, [1.0], None), (7, [-1e300, 1e300], None), (3, [1.0, 2.0], "a"), (8, [-0.5, -0.0], "a")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = codes.compressed(vectors, scratch)[0].collect()
    assert sorted(r.vec_id or -1 for r in got) == [-1, 1, 3, 3, 7, 8] and all(len(r.code) == 8 and r.error == 0 for r in got)
    empty, books = codes.compressed(vectors.limit(0), scratch)
    assert empty.count() == 0 and books.entries.size == 0


def brute_ranks(docs, items, k, repeats=False):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, split(t)) for i, t in docs if split(t)]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = set()
    for item in {i for i, _ in items}:
        wanted = Counter(x for i, t in items if i == item for x in split(t))
        scores = []
        for i, t in held:
            tf, m = Counter(t), 10 + 90 * len(t) * n // total
            weigh = lambda x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
            score = sum((c if repeats else 1) * weigh(x) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x, c in wanted.items() if tf[x])
            if score > 0:
                scores.append((-score, i is None, i))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("sizes", [(16 << 20, 8192), (200, 3)])
def test_ranks_equal_brute_force(spark, scratch, monkeypatch, repeats, sizes):
    """Ties, repeated rows, null and empty texts, letters outside ASCII; one block and many."""
    monkeypatch.setattr(ranking, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(ranking, "DOCUMENTS", sizes[1])
    words = "Aal Äal über b2b x-ray it's 東京 東京都  nbsp\u0085x The the THE cat sat on mat".split(" ")
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(words[j] for j in rng.integers(0, len(words), n))
    docs = [(i, some(1 + i % 9)) for i in range(60)] + [(i + 60, "the cat") for i in range(20)] + [(100, None), (101, ""), (102, "-- ..."), (None, "the cat sat"), (103, "cat " * 5000)]
    items = [(i, some(4)) for i in range(12)] + [(20, "the the cat"), (20, "mat"), (21, None), (22, "?"), (23, "absent"), (None, "cat")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Score", F.lit("x")).withColumn("N", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    got = {tuple(r) for r in ranking.ranked(table, asked, scratch, 10, repeats).collect()}
    assert got == brute_ranks(docs, items, 10, repeats)
    assert ranking.ranked(table.limit(0), asked, scratch).count() == 0 and ranking.ranked(table, asked.limit(0), scratch).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for t in range(120):
        n = int(rng.integers(1, 80))
        x = rng.integers(0, 1 + t % 4, n).astype(np.uint8) if t % 2 else np.tile(rng.integers(0, 3, 7).astype(np.uint8), 12)[:n]
        raw = x.tobytes()
        order = sorted(range(n), key=lambda i: raw[i:])
        shared = [next((c for c in range(n) if raw[i + c : i + c + 1] != raw[j + c : j + c + 1] or i + c == n), 0) for i, j in zip(order[1:], order)]
        assert suffixes.suffix_array(x).tolist() == order
        assert suffixes.common_prefixes(x, np.array(order)).tolist() == [0, *shared]


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, dtype=bool)
        for s in range(len(r) - length + 1):
            if n[r[s : s + length]] > 1:
                gone[s + 1 : s + 1 + length] = True
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    """Unlike texts around passages that some of them share, edited copies, and texts of few different letters."""
    rng = np.random.default_rng(seed)
    some = lambda k, abc="abcdefgh é東": "".join(abc[j] for j in rng.integers(0, len(abc), k))
    passages = [some(k) for k in (19, 20, 21, 33, 60, 150)]
    out = []
    for i in range(n):
        out.append(some(int(rng.integers(0, 40))) + passages[int(rng.integers(0, 6))] + some(int(rng.integers(0, 40))))
        if i % 5 == 0:
            at = int(rng.integers(0, len(out[-1])))
            out.append(out[-1][:at] + some(2) + out[-1][at + 1 :])
    return [*out, "a" * 90, "ab" * 40, "ab" * 9 + "a", "ab" * 10, None, "", "x", out[0], out[0], some(300, "xy")]


@pytest.mark.parametrize("group, shard, piece", [(1000, 1 << 20, 4 << 20), (1, 1 << 20, 64), (3, 300, 30), (1000, 200, 4 << 20), (5, 90, 45)])
def test_repeats_equal_brute_force(spark, scratch, monkeypatch, group, shard, piece):
    """Hot keys that are split, keys that lie in several shards, long texts in pieces; ties, copies, nulls, letters of
    several bytes."""
    for name, value in (("GROUP", group), ("SHARD", shard), ("PIECE", piece)):
        monkeypatch.setattr(repeats, name, value)
    texts = corpus(group + shard)
    ids = [i if i % 9 else None for i in range(len(texts) - 1)] + [3]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("HASH", F.lit("x")).withColumn("n", F.lit(1)).repartition(4)
    got = Counter(tuple(r) for r in repeats.repeated_bytes(docs, scratch, 20).collect())
    assert got == Counter((i, *b) for i, b in zip(ids, brute_repeats(texts, 20)))
    assert repeats.repeated_bytes(docs.limit(0), scratch, 20).count() == 0


def test_texts_without_repeats(spark, scratch):
    same = "the very same sentence, over and over, of more than forty bytes"
    docs = spark.createDataFrame([(1, "a " + same), (2, same + " b"), (3, None), (4, "short")], "doc_id long, text string").withColumn("Found", F.lit(1))
    out = repeats.without_repeats(docs, scratch, 40)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "a ", 2: " b", 3: None, 4: "short"}


def test_a_hot_passage_is_gathered_nowhere(spark, scratch, monkeypatch):
    """Four hundred texts share a line; of any key, at most GROUP texts reach a task."""
    monkeypatch.setattr(repeats, "GROUP", 8)
    plain = repeats._searched

    def counted(length):
        search = plain(length)

        def run(batches):
            rows = Counter()

            def told():
                for b in batches:
                    rows.update(b.column("key").to_pylist())
                    assert max(rows.values()) <= 8
                    yield b

            yield from search(told())

        return run

    monkeypatch.setattr(repeats, "_searched", counted)
    rng = np.random.default_rng(4)
    line = "a line that is in every text, shorter than a window"
    some = lambda: hashlib.sha256(rng.bytes(8)).hexdigest()
    docs = spark.createDataFrame([(i, some() + line + some()) for i in range(400)], "doc_id long, text string")
    assert {r.n_removed for r in repeats.repeated_bytes(docs, scratch, 60).collect()} == {0}
