"""The methods inside the operators, each held against a plain computation of the same thing."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, components, embeddings, labels, minhash, pii, quality, tokens, toxicity, urls
from siltstone.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "methods")


def brute_components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def vectors_of(spark, x, label):
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def clusters(n, wide, spread, dim=24, seed=3):
    """``n`` unit vectors around ``wide`` directions."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(wide, dim))[rng.integers(0, wide, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("spread", [0.05, 0.25, 3.0])
def test_cells_lose_no_link(spark, scratch, spread):
    """Narrow clusters, clusters whose pairs lie on both sides of the threshold, and no clusters at all."""
    x = clusters(600, 30, spread)
    label = np.arange(600) % 3 // 2
    got = embeddings.near_embeddings(vectors_of(spark, x, label), scratch, cell=16, sample=400).collect()
    near = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(600, dtype=bool)
    low = brute_components(range(600), zip(*(v.tolist() for v in np.nonzero(near))))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()), low[i]) for i in range(600)}


def test_more_cells_mean_less_work_on_clusters(spark, scratch):
    """Tile rows of a vector and compared pairs fall as cells become smaller, where there are clusters to find."""
    x = clusters(1500, 50, 0.08)
    heads = vectors_of(spark, x, np.zeros(1500)).selectExpr("label", "encode(string(vec_id), 'utf-8') AS key", "vec_id AS node", "1L AS weight", "embedding")
    pack = F.udf(lambda v: np.array(v).tobytes(), "binary")
    heads = heads.select("label", "key", "node", "weight", pack("embedding").alias("unit"))
    share = []
    for cell in (1500, 300, 60):
        placed = embeddings.cells_of(heads, scratch, 0.93, cell=cell).groupBy("cell", "part", "other_cell", "other_part")
        sides = {(tuple(r[:2]), tuple(r[2:4])): r[4] for r in placed.count().collect()}
        share.append(sum(n * sides.get((b, a), 0) for (a, b), n in sides.items()) / 1500**2)
    assert share[0] == 1 and share[1] < 0.4 and share[2] < 0.1


@pytest.mark.parametrize("limits", [(1_000_000, 10_000), (0, 30), (0, 1)])
def test_components_with_and_without_hubs(spark, scratch, monkeypatch, limits):
    """Broadcast minima, a split hub among plain nodes, and hubs everywhere give the same components."""
    monkeypatch.setattr(components, "BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(components, "HUB", limits[1])
    rng = np.random.default_rng(5)
    links = [(5, 1000 + i) for i in range(80)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2120, (90, 2)) if a != b]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"), scratch).collect()
    assert {r.node: r.component for r in got} == brute_components({x for p in links for x in p}, links)
    assert len(got) == len({r.node for r in got})


def fold_by_hand(events):
    """Final messages of one conversation's events, one event after the other."""
    low = -(2**63)
    of = defaultdict(set)
    for turn, part, seq, kind, role, text in events:
        of[turn, part].add((low if seq is None else seq, kind, role, text or ""))
    out, states = {}, {}
    for place, log in of.items():
        sets = [e[0] for e in log if e[1] in ("message", "edit", "regenerate")]
        since = max(sets) if sets else min(e[0] for e in log)
        text = "".join(t for _, t in sorted({(e[0], e[3]) for e in log if e[0] >= since}))
        roles = sorted((e[0], e[2]) for e in log if e[2] is not None)
        again = [e[0] for e in log if e[1] == "regenerate"]
        states[place] = since, max(again) if again else None
        out[place] = (roles[-1][1] if roles else "", text)
    for (turn, part), (since, _) in states.items():
        if any(t < turn and a is not None and a > since for (t, _), (_, a) in states.items()):
            del out[turn, part]
    return out


def test_folding_random_logs(spark):
    """Events out of order, delivered twice, with tied and null numbers, of several conversations at once."""
    rng, rows = random.Random(4), []
    for conv in range(25):
        own = []
        for _ in range(rng.randrange(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", None, "odd"])
            seq = None if rng.random() < 0.1 else rng.randrange(12)
            own.append((rng.randrange(4), rng.randrange(2), seq, kind, rng.choice([None, "user", "assistant"]), rng.choice([None, "a", "b ", "<|"])))
        own += rng.sample(own, len(own) // 3)
        rng.shuffle(own)
        rows += [(conv, *e) for e in own]
    events = spark.createDataFrame(rows, "conv_id long, turn long, part int, seq int, kind string, role string, text string")
    got = {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in chat.fold_events(events).collect()}
    want = {(c, *k): v for c in range(25) for k, v in fold_by_hand([r[1:] for r in rows if r[0] == c]).items()}
    assert got == want


def test_streamed_logs_end_in_the_turns(spark):
    """Deltas, edits and regenerations occur, and nothing of a null, tied, repeated, long or odd turn is lost."""
    long = "".join(chr(0x4E00 + i % 500) for i in range(40_000))
    rows = [(1, None, "user", "first"), (1, 0, "assistant", long), (1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (1, 1, None, None), (1, 2, "assistant", ""), (None, 1, "user", "<|im_end|>")]
    rows += [(100 + i, t, ("user", "assistant")[t], f"text {i} " * 50) for i in range(30) for t in (0, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Part", F.lit("x")).withColumn("seq", F.lit(1))
    log = chat.streamed_log(turns.select("conv_id", "turn", "role", "text")).cache()
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("delta", "edit", "message", "regenerate")) > 3
    assert log.where("conv_id = 1 and kind = 'delta'").count() > chat.DELTAS
    read = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.parse(chat.format_conversations(turns)).collect()}
    by = lambda c: sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert read == {c: [(r[2] or "", r[3] or "") for r in by(c)] for c in {r[0] for r in rows}}


def test_rollup_history_equals_a_loop(spark, scratch):
    """Random inserts, revisions and deletes, batches that come again, names with any characters, and a compaction."""
    rng, rollup, now = random.Random(6), tokens.Rollup(spark, f"{scratch.root}/h"), {}
    kind = "doc_id long, source string, lang string, n_tokens long, tokenizer string"
    for step, name in enumerate(["a/b", "..", "c d", "é=1", "e"]):
        version = "v1" if step != 3 else "v2"
        rows = [(i, rng.choice("xy"), rng.choice(["en", None]), rng.randrange(9), "clash") for i in rng.sample(range(12), rng.randrange(6))]
        gone = [] if step == 0 else rng.sample(range(12), 3)
        gone = [i for i in gone if i not in {r[0] for r in rows}]
        deletes = spark.createDataFrame([(i,) for i in gone], "doc_id long")
        for again in (False, True):
            assert rollup.commit(name, spark.createDataFrame(rows, kind), version, deletes) is not again
        for i in gone:
            now.pop((i, version), None)
        now |= {(r[0], version): r[1:4] for r in rows}
        if step == 2:
            assert rollup.compact("all so far") and rollup.batches() == ["all so far"]
        want = defaultdict(lambda: (0, 0))
        for (_, v), (source, lang, n) in now.items():
            want[source, lang, v] = (want[source, lang, v][0] + 1, want[source, lang, v][1] + n)
        got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
        assert got == want


def test_a_group_of_near_copies_costs_rows_in_proportion(spark, scratch, monkeypatch):
    """A family of distinct near copies with strangers in its buckets: every link is found, each member is compared in
    few tiles, and twice the members make about twice the rows."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 32)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 16)
    rows = []

    def counted(compare):
        def run(tiles):
            rows[-1] += tiles.count()
            return compare(tiles)

        return run

    linked = minhash._linked
    monkeypatch.setattr(minhash, "_linked", lambda m, compare, block, s: linked(m, counted(compare), block, s))
    base = [f"w{i}" for i in range(120)]
    for n in (150, 300):
        rows.append(0)
        texts = [" ".join([*base[: i % 100], f"new{i}", *base[i % 100 :]]) for i in range(n)]
        texts += [" ".join(f"x{i}y{j}" for j in range(30)) for i in range(20)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, scratch).collect()}
        assert got == {i: 0 if i < n else i for i in range(n + 20)}
    assert rows[1] < 3 * rows[0]


def test_texts_of_a_repeated_id_join_their_groups(spark, scratch):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b, "end"])), (9, " ".join(reversed(b)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, scratch).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 9)}
    assert sorted(r.doc_id for r in minhash.deduplicate(docs, scratch).collect()) == [3, 9]


def test_cascades_rehash_and_stay_exact(monkeypatch):
    """Two keys that share a hash get another seed; every key of the universe is told right at every level."""
    keys = [f"k{i}" for i in range(400)]
    plain = urls._hash
    monkeypatch.setattr(urls, "_hash", lambda ks, seed=0: plain(ks, seed) if seed else plain(["same" if k in ("k1", "k2") else k for k in ks], 0))
    built = urls._build(pd.DataFrame({"key": keys, "listed": [i % 3 == 0 for i in range(400)], "shard": 4}))
    (seed, levels), = urls._by_shard(built).values()
    assert seed == 1 and len(levels) > 1
    assert urls._inside(levels, urls._hash(keys, seed)).tolist() == [i % 3 == 0 for i in range(400)]


def test_reliabilities_agree_with_hand_counts():
    """Two labelers that always agree with the hidden class, one that never speaks, one that always says yes: the
    posteriors follow the first two, and the smoothed counts are those of one more step by hand."""
    patterns, n = ["++0+", "--0+", "+-0+"], np.array([60.0, 90.0, 2.0])
    q = pii.reliabilities(patterns, n)
    assert q[0] > 0.95 and q[1] < 0.05 and q[1] < q[2] < q[0]
    mass = n.sum() / 5
    prior = np.array([[4.0, 2.5, 1.0], [1.0, 2.5, 4.0]]) * mass / 7.5
    logs = np.zeros((2, 3))
    for side, p in ((0, (1 - q) * n), (1, q * n)):
        logs[side] += np.log(p.sum() + mass * (0.9, 0.1)[side])
        for j in range(4):
            rate = [sum(w for w, v in zip(p, patterns) if v[j] == c) + prior[side][k] for k, c in enumerate("-0+")]
            logs[side] += [np.log(rate["-0+".index(v[j])] / sum(rate)) for v in patterns]
    assert np.allclose(q, 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-4)


PLANTED = [
    ("Herr {}, guten Tag", "name", ["Friedrich", "Zhang Wei", "Bob Smith"]), ("mein name ist {} und", "name", ["Maria Lopez", "Paul Meier"]),
    ("the token = \"{}\" was", "secret", ["ab12" * 10, "Zx9_" * 60, "k7/Q+" * 5 + "==", "A1b2C3d4E5f6G7h8"]), ("follow {} now", "handle", ["@jo_doe99", "@m1_" + "x" * 40]),
    ("pay to IBAN {} today", "account", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]),
]
PLAIN = ["see src/main/java/app1/Test2/view3 here", "The Old House and the house", "@media (x) and @param y", "MIT License text", "Of Of Of", "a plain line of text", "id 12345678901234567890"]


def test_added_spans_are_found_and_plain_texts_left_alone(spark):
    texts = [t.format(v) for t, _, values in PLANTED for v in values for _ in range(8)] + PLAIN * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_private(docs, pii.train(docs)).collect()}
    want = [f"{k}:{t.index('{')}:{t.index('{') + len(v)}" for t, k, values in PLANTED for v in values for _ in range(8)]
    right = sum(w in got[i].split(",") for i, w in enumerate(want))
    said = sum(len(g.split(",")) for g in got.values() if g)
    assert right / len(want) >= 0.95 and right / said >= 0.95
    assert not any(got[i] for i in range(len(want), len(texts)))


def test_attention_gradients_equal_differences():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    starts, x, y = np.cumsum(counts) - counts, rng.normal(size=(8, quality.SHAPE)), np.array([1.0, 0.0, 1.0])
    sizes = {"encode": (quality.SHAPE, 3), "encode0": 3, "tanh": (3, 2), "gate": (3, 2), "attend": 2, "score": 3, "score0": 1}
    p = {k: rng.normal(0, 0.4, size=s) for k, s in sizes.items()}

    def loss():
        out = quality.forward(p, x, starts, counts)["y"]
        return -(y * np.log(out) + (1 - y) * np.log(1 - out)).mean()

    f = quality.forward(p, x, starts, counts)
    assert np.allclose(np.add.reduceat(f["a"], starts), 1)
    grads = quality.backward(p, f, x, counts, starts, (f["y"] - y) / 3)
    for k in p:
        flat, slope = p[k].reshape(-1), np.asarray(grads[k]).reshape(-1)
        for i in range(0, len(flat), 7):
            flat[i] += 1e-5
            up = loss()
            flat[i] -= 2e-5
            down = loss()
            flat[i] += 1e-5
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-6


def test_passages_hold_the_words_of_whole_texts():
    long = " ".join(f"word{i}" for i in range(1000))
    x, counts = quality.passages([b"", long.encode(), b"one two"])
    assert counts.tolist() == [1, 8, 1] and x.shape == (10, quality.SHAPE) and not x[0].any()
    again = quality.passages([long.encode()])[0]
    assert np.allclose(x[1:9], again) and np.abs(x[9, -quality.HASHED:]).sum() > 0


def test_label_model_weighs_voters_by_what_they_are_worth():
    """Good voters, a voter by chance, and three copies of a weak one that must not count three times."""
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.3
    speak = lambda inside, outside: np.where(truth, rng.random(3000) < inside, rng.random(3000) < outside)
    weak = speak(0.3, 0.1)
    votes = np.column_stack([speak(0.7, 0.02), speak(0.6, 0.03), speak(0.3, 0.3), weak, weak, weak]).astype(float)
    votes = np.column_stack([votes, votes.sum(axis=1) == 0])
    accuracy = np.array([0.8, 0.8, 0.4, 0.5, 0.5, 0.5, 0.1])
    q = toxicity.label_model(votes, accuracy, 0.3)
    strong, chance, silent = (votes[:, :2].sum(axis=1) > 0), (votes[:, 2] > 0) & (votes[:, [0, 1, 3]].sum(axis=1) == 0), votes[:, 6] > 0
    assert q[strong].mean() > q[chance].mean() + 0.2 > q[silent].mean() + 0.4
    one = toxicity.label_model(votes[:, [0, 1, 2, 3, 6]], accuracy[[0, 1, 2, 3, 6]], 0.3)
    only_weak = (votes[:, :3].sum(axis=1) == 0) & weak
    assert abs(q[only_weak].mean() - one[only_weak].mean()) < 0.1


def test_samples_are_bounded_and_hold_each_id_once(spark, scratch, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"{i:03d} " * 10) for i in range(100)] + [(None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    whole = labels.labelled_sample(docs, known, "toxic", F.lit(True), 1000, scratch).collect()
    assert len(whole) == 50 and {r.text[:3] for r in whole} == {f"{i:03d}" for i in range(50)}
    monkeypatch.setattr(labels, "CHARS", 400)
    assert len(labels.labelled_sample(docs, known, "toxic", F.lit(True), 1000, scratch).collect()) == 10
    assert len(labels.labelled_sample(docs, known, "toxic", F.lit(True), 5, scratch).collect()) == 5
