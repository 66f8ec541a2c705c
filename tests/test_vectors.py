"""Stored vectors, judgements, replies and ids on small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import parse, vector
from siltstone.operators import vectors
from siltstone.plans import QUERIES


def test_ids_are_the_standard_ones(spark, sf):
    found = QUERIES["stable_ids"](spark, sf).collect()
    assert found
    for r in found:
        assert r.stable_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.parent_id}:{r.id}"))
    odd = spark.createDataFrame([("",), ("é一",), (None,)], "n string").select("n", parse.named_id(uuid.NAMESPACE_DNS, F.col("n")).alias("i"))
    for r in odd.where("n is not null").collect():
        assert r.i == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n))


def test_replies(spark):
    replies = ['{"a": 1}', 'x {"a": 2} y', "```json\n{\"a\": 3}\n```", '<think>{"a": 9}</think>{"a": 4}', "none", "", None, "{broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = [r.r.a if r.r else None for r in df.select("i", parse.model_json(F.col("reply"), "a int").alias("r")).orderBy("i").collect()]
    assert got == [1, 2, 3, 4, None, None, None, None]


def test_cache_asks_once_for_each_missing_text(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "id long, text string")
    embed = lambda d: d.select("hash", F.array(F.length("text").cast("double")).alias("vector"))
    cache = spark.createDataFrame([("a",)], "text string").select(F.sha2("text", 256).alias("hash"), F.array(F.lit(7.0)).alias("vector"))
    found, made = vectors.embedded(texts, cache, embed)
    assert made.count() == 2
    assert {r.id: (r.vector, r.cached) for r in found.collect()} == {1: ([7.0], True), 2: ([7.0], True), 3: ([1.0], False), 4: ([0.0], False), 5: ([0.0], False)}


def test_kinds_and_judgements_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, " ", [1.0] * 8), (3, "c", [1.0] * 8), (4, None, None)], "id long, text string, vector array<double>")
    own = spark.createDataFrame([(5, "e")], "id long, text string").withColumn("vector", vector.hashed(F.col("text"), 8))
    assert {r.id: r.kind for r in vectors.kinds(rows.unionByName(own), 8).collect()} == {1: "none", 2: "unknown", 3: "semantic", 4: "unknown", 5: "hash"}
    records = spark.createDataFrame([(1, "2024-01-01", 0.5), (2, "2024-01-01", 0.5), (3, "2024-01-02", 0.1), (4, None, None)], "id long, updated_at string, importance double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (4, 1), (1, 9)], "a long, b long")
    got = {(r.a, r.b): r.keep for r in vectors.decided(pairs, records).collect()}
    assert got == {(1, 2): 1, (2, 1): 1, (1, 3): 3, (4, 1): 1}
