"""The numbered queries against SQL, brute force or held-out labels, and the operators on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import compare
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import chat, embeddings, mixing, pii, quality, queries, tokens, toxicity, urls
from siltstone.llm.common import Scratch
from siltstone.llm.components import connected_components
from siltstone.llm.decontaminate import contaminated, decontaminate
from siltstone.llm.labels import fold
from siltstone.llm.minhash import deduplicate, near_duplicates
from siltstone.llm.oracles import ORACLES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def documents(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare.differences(queries.QUERIES[name](spark, sf), con, ORACLES[name]) == []


def brute_spans(text):
    """The base spans by the plain patterns of the contract."""
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_equals_plain_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_pii_weak_supervision(spark, sf).collect():
        base = brute_spans(texts[r.doc_id])
        named = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    "text",
    ["", "a@b@c.de x@y.z.", "1.2.3.4.5 999.1.1.1 1.1.1.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999, +12, ++49 30 1234567", "é@x.de ü4111111111111111", "1" * 40 + ".1.1.1", "a" * 3000 + "@" * 50],
)
def test_base_spans_of_awkward_texts(text):
    found = [(k, s, e) for k, spans in pii.base_spans(text).items() for s, e in spans]
    assert found == brute_spans(text)


def test_pii_nulls_and_redaction(spark):
    docs = documents(spark, [None, "", "write to jo@ex.org now", "write to jo@ex.org now"]).withColumn("found", F.lit(1))
    model = pii.train(docs)
    assert [r.n_email for r in pii.find_private(docs, model).orderBy("doc_id").collect()] == [0, 0, 1, 1]
    assert [r.text for r in pii.redact(docs, model).orderBy("doc_id").collect()] == [None, "", "write to [EMAIL] now", "write to [EMAIL] now"]
    assert pii.find_private(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def encoding(version="byte_bpe_multi_50k"):
    path = queries.VOCABULARIES[version].removeprefix("file://")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_totals_equal_a_loop(spark, sf):
    want = {}
    for version in queries.VOCABULARIES:
        enc = encoding(version)
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            n, t = want.get((r.source, r.lang, version), (0, 0))
            want[r.source, r.lang, version] = (n + 1, t + len(enc.encode_ordinary(r.text or "")))
    got = queries.op5_token_counts(spark, sf).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == want


def test_token_pieces_add_up():
    enc = encoding()
    text = ("word  two\n\nthree 4 5 " * 30_000) + "x" * 100
    parts = list(tokens.pieces(text))
    assert len(parts) > 5 and "".join(parts) == text
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_rollup_takes_changes_and_is_idempotent(spark, scratch):
    rollup = tokens.Rollup(spark, f"{scratch.root}/r")
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, source string, lang string, n_tokens long")
    assert rollup.totals().count() == 0
    assert rollup.commit("1", batch((1, "a", "en", 5), (2, "a", None, 7), (None, "b", "en", 1)), "v1")
    assert not rollup.commit("1", batch((9, "z", "en", 100)), "v1")
    assert rollup.commit("2", batch((1, "b", "en", 6)), "v1", batch((2, "", "", 0)).select("doc_id"))
    assert rollup.commit("3", batch((1, "a", "en", 50)), "v2")
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("b", "en", "v1", 2, 7), ("a", "en", "v2", 1, 50)}


def _accuracies(scored, labels, column):
    """The share of held-out documents of either label that are predicted right, and the area under the curve."""
    both = scored.join(labels, "doc_id").where("held_out").select("predicted", column, "score").collect()
    shares = [[r.predicted == k for r in both if r[column] == k] for k in (0, 1)]
    low, high = ([r.score for r in both if r[column] == k] for k in (0, 1))
    area = sum((h > x) + (h == x) / 2 for h in high for x in low) / len(high) / len(low)
    return *(sum(s) / len(s) for s in shares), area


def test_held_out_accuracy(spark):
    """At sf0.1, where there are enough labels to learn from. A constant would have one share of 0 and an area of .5."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for query, column, least in ((queries.op8_quality_classifier, "quality", (0.95, 0.95, 0.98)), (queries.op9_toxicity, "toxic", (0.98, 0.9, 0.95))):
        scored = query(spark, sf).cache()
        assert scored.count() == 10_000
        got = _accuracies(scored, labels, column)
        print(column, got)
        assert all(g >= x for g, x in zip(got, least))
        held = scored.select("doc_id", "held_out").where("held_out").collect()
        assert all(zlib.crc32(str(r.doc_id).encode()) % (5 if column == "quality" else 4) == (0 if column == "quality" else 2) for r in held)


def test_classifiers_on_awkward_rows(spark, scratch):
    docs = documents(spark, [None, "", "good text here", "x" * 200_000]).withColumn("label", F.lit("z")).withColumn("SCORE", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for f in (quality.quality_scores, toxicity.toxicity_scores):
            scores = [r["out"] for r in f(docs, labels, F.lit(True), scratch, "out").collect()]
            assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    kept = toxicity.drop_toxic(docs, toxicity.train(toxicity.sample_of(docs, none, F.lit(True), scratch)))
    assert kept.columns == docs.columns and kept.count() == 4


@pytest.mark.parametrize("near", [False, True])
def test_toxic_stems_beside_a_large_toxic_group(spark, scratch, near):
    """A third of the rows are copies, or near copies, of one toxic text with more tokens than any list of 1,500."""
    name = lambda kind, i: kind + hashlib.md5(f"{kind}{i}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:9]
    stems, plain = ["reeux", "achlich", "bomente"], lambda i: " ".join(name("c", (i * 7 + j * 11) % 300) for j in range(30))
    group = " ".join(name("t", i) for i in range(700))
    toxic = [f"{plain(i)} {stems[i % 3]}{name('z', i)[1:4]}" for i in range(45)]
    toxic += [f"{group} edit{name('e', i)}" if near else group for i in range(180)]
    texts = toxic + [plain(1000 + i) for i in range(300)]
    held = [f"{plain(i)} {stems[i % 3]}qqq" for i in range(60, 90)] + [plain(2000 + i) for i in range(30)]
    docs = documents(spark, texts + held)
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(texts))], "doc_id long, toxic int")
    scored = toxicity.toxicity_scores(docs, labels, F.lit(True), scratch, "s").where(F.col("doc_id") >= len(texts))
    got = {r.doc_id - len(texts): r.s >= 0.3 for r in scored.collect()}
    assert got == {i: i < 30 for i in range(60)}


def test_near_duplicates_on_awkward_rows(spark, scratch):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(None, long), (5, long), (3, long + " more"), (7, None), (8, "  "), (9, "A b"), (2, "a  B"), (2, "a b"), (11, "other words entirely here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("Component", F.lit(0))
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs, scratch).collect()}
    assert got == {(None, None), (5, 3), (3, 3), (7, 7), (8, 8), (9, 2), (2, 2), (11, 11)}
    kept = deduplicate(docs, scratch)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 7, 8, 11]
    assert near_duplicates(docs.limit(0), scratch).count() == 0


def test_components_of_a_path_and_a_star(spark, scratch):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_contamination_inside_a_long_text(spark, scratch):
    item = "what is the capital of the oldest town on the river"
    texts = ["word " * 5000 + item + " tail" * 5000, item.upper(), "what is the capital of another", None, "", item + " " + item]
    docs = documents(spark, texts).withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (1, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, scratch).collect()} == {(0, 1), (1, 1), (5, 1)}
    kept = decontaminate(docs, items, scratch)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert contaminated(docs, items.limit(0), scratch).count() == 0


def test_folding_of_events(spark):
    rows = [
        (1, 0, 1, 0, "message", "user", "hi"), (1, 1, 1, 1, "delta", "assistant", "he"), (1, 1, 1, 2, "delta", None, "llo"),
        (1, 2, 1, 3, "message", "user", "bye"), (1, 1, 1, 4, "regenerate", None, "hey"), (1, 1, 1, 5, "delta", None, None),
        (1, 0, 1, 6, "edit", None, "hi!"), (None, None, 1, 0, None, None, "<|im_end|>\\"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, turn long, part int, seq int, kind string, role string, text string")
    read = {r.conv_id: r for r in chat.parse(chat.render(chat.fold_events(events))).collect()}
    assert [tuple(t) for t in read[1].turns] == [("user", "hi!"), ("assistant", "hey")] and read[1].learned == ["hey"]
    assert [tuple(t) for t in read[None].turns] == [("", "<|im_end|>\\")]
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_mixing_keeps_means(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "if(id % 10 = 0, 'small', null) AS source", "1 AS parts", "2 AS mean")
    weights = spark.createDataFrame([("small", 1.0), (None, 1.0)], "source string, weight double")
    mixed = mixing.mix_sources(docs, weights)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(2000, rel=0.1) and n[None] == pytest.approx(2000, rel=0.1)
    assert mixed.exceptAll(mixing.mix_sources(docs.repartition(9), weights)).count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_url_lists_are_exact(spark, scratch):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 700, '.net/x') AS url").unionByName(
        spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http:// a b /p"), (-4, "HTTP://A.ORG#x")], "page_id long, url string")
    )
    listed = spark.range(0, 700, 3).selectExpr("concat('h', id, '.net') AS host").unionByName(spark.createDataFrame([(None,), (" a b ",)], "host string"))
    want = {i: "block" if i % 700 % 3 == 0 else "allow" for i in range(3000)} | {-1: "allow", -2: "allow", -3: "block", -4: "allow"}
    assert {r.page_id: r.verdict for r in urls.judge_pages(pages, listed, scratch).collect()} == want
    urls.BROADCAST_BYTES, before = 0, urls.BROADCAST_BYTES
    try:
        assert {r.page_id: r.verdict for r in urls.judge_pages(pages, listed, scratch).collect()} == want
    finally:
        urls.BROADCAST_BYTES = before
    assert urls.judge_pages(pages.limit(0), listed, scratch).count() == 0


def test_embeddings_on_awkward_rows(spark, scratch):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [float("nan"), 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("KEY", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_embeddings(vectors, scratch).collect()}
    assert got == {i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11)} | {None: (0, None), 1: (2, 1), 2: (2, 1), 3: (2, 1)}
    assert embeddings.near_embeddings(vectors.limit(0), scratch).count() == 0


def brute_groups(docs, width=5, percent=80):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    low = {i: i for i in docs}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in ids:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not changed:
            break
    return low, sets


def test_pipeline_equals_brute_force(spark, sf):
    """Each stage on its own input: which rows it keeps, and what it makes of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark, "pipeline-test")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(scratch.save(stage(spark, steps[-1], sf), name))
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"), fold("doc_id", 4) != 2, scratch, "s")
    assert set(texts[1]) == {r.doc_id for r in scored.where("s < 0.3").collect()}
    low, sets = brute_groups(texts[1])
    assert set(texts[2]) == {i for i in texts[1] if low[i] == i}
    items = brute_groups({r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()})[1]
    assert set(texts[3]) == {i for i in texts[2] if not any(v and 100 * len(v & sets[i]) >= 80 * len(v) for v in items.values())}
    assert set(texts[4]) == set(texts[3])
    model = pii.train(steps[3])
    assert texts[4] == {i: pii.redacted(t, model) for i, t in texts[3].items()}
    assert all(not brute_spans(t) or brute_spans(t) != brute_spans(texts[3][i]) for i, t in texts[4].items())
    assert [s.columns for s in steps[1:5]] == [docs.columns] * 4
    last = corpus_pipeline.run(spark, sf)
    assert last.exceptAll(steps[5]).count() == 0 and last.count() == steps[5].count()
    empty = corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf)
    for _, stage in corpus_pipeline.STAGES[1:]:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
