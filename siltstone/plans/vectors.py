"""Stored vectors, judgements between pairs, and a model's replies."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import parse, vector
from siltstone.operators import judging, vectors
from siltstone.plans.registry import query
from siltstone.sources.scratch import shared_folder
from siltstone.sources.views import view


@query("""SELECT id, sha256(content) AS hash, sha256(content) IN (SELECT sha256(content) FROM memories WHERE id % 3 = 0) AS cached FROM memories""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a third of the records are at hand; the others are made, once for each text."""
    texts = view(spark, sf_dir, "memories").select("id", F.col("content").alias("text"))

    def embed(asked: DataFrame) -> DataFrame:
        return asked.select("hash", vector.hashed(F.col("text"), 64).alias("vector"))

    cache = embed(texts.where("id % 3 = 0").select(F.sha2("text", 256).alias("hash"), "text"))
    return vectors.embedded(texts, cache, embed)[0].select("id", "hash", "cached")


@query("""SELECT id, CASE WHEN trim(content) = '' THEN 'unknown' WHEN vec_id IS NULL THEN 'none' WHEN id % 4 = 0 THEN 'hash' ELSE 'semantic' END AS kind
FROM memories LEFT JOIN embeddings ON vec_id = id""")
def vector_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth stored vector is replaced by one made of the text's digest."""
    stored = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector.doubles(F.col("embedding")).alias("stored"))
    both = view(spark, sf_dir, "memories").select("id", F.col("content").alias("text")).join(stored, "id", "left")
    mixed = F.when(F.col("stored").isNotNull() & F.expr("id % 4 = 0"), vector.hashed(F.col("text"), 64)).otherwise(F.col("stored"))
    return vectors.kinds(both.select("id", "text", mixed.alias("vector")), 64)


@query("""WITH p AS (SELECT DISTINCT source_id AS a, target_id AS b FROM links), j AS (SELECT a, b,
    (x.updated_at, x.importance, -a) >= (y.updated_at, y.importance, -b) AS first FROM p JOIN memories x ON x.id = a JOIN memories y ON y.id = b)
SELECT a, b, CASE WHEN first THEN a ELSE b END AS keep, CASE WHEN first THEN b ELSE a END AS drop FROM j""")
def pair_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "links").selectExpr("source_id AS a", "target_id AS b").distinct()
    return vectors.decided(pairs, view(spark, sf_dir, "memories"))


def longer(prompts: list[str]) -> list[str | None]:
    """A judge for want of a model: of two records the longer text stays, and equal ones are kept both."""
    out: list[str | None] = []
    for a, b in ((p["a"], p["b"]) for p in map(json.loads, prompts)):
        here, there = len(a["content"] or ""), len(b["content"] or "")
        found = {"action": "keep_both"} if here == there else {"action": "merge", "keep": (a if here > there else b)["id"]}
        out.append(f"Compared.\n```json\n{json.dumps(found)}\n```")
    return out


@query("""WITH p AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM links WHERE source_id <> target_id),
j AS (SELECT a, b, coalesce(length(x.content), 0) AS la, coalesce(length(y.content), 0) AS lb FROM p JOIN memories x ON x.id = a JOIN memories y ON y.id = b)
SELECT a, b, CASE WHEN la = lb THEN 'keep_both' ELSE 'merge' END AS action, CASE WHEN la > lb THEN a WHEN lb > la THEN b END AS keep,
  CASE WHEN la > lb THEN b WHEN lb > la THEN a END AS drop, 'judged' AS state FROM j""")
def curator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curation run over all linked pairs, through the store of replies."""
    store = judging.Judgements(spark, f"{shared_folder(spark)}/judged-{uuid.uuid4().hex}", "longer")
    pairs = view(spark, sf_dir, "links").selectExpr("source_id AS a", "target_id AS b")
    return judging.curated(pairs, view(spark, sf_dir, "memories"), store, longer, budget=256_000_000).drop("reason")


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS pair, CASE WHEN event_id % 5 > 0 THEN event_type END AS action FROM events""")
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with thoughts and fences; every fifth holds no JSON."""
    body = F.concat(F.lit('<think>{"pair": 0}</think> Sure:\n```json\n{"pair": '), F.col("user_id"), F.lit(', "action": "'), F.col("event_type"), F.lit('"}\n```'))
    reply = F.when(F.expr("event_id % 5 > 0"), body).otherwise("<think>{}</think> I can't tell.")
    read = view(spark, sf_dir, "events").select("event_id", parse.model_json(reply, "pair long, action string").alias("r"))
    return read.select("event_id", "r.pair", "r.action")


@query()
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of atomic facts by their parent and place; a test holds them against the standard library's."""
    name = F.concat_ws(":", F.col("parent_id").cast("string"), F.col("id").cast("string"))
    facts = view(spark, sf_dir, "memories").where("kind = 'atomic_fact'")
    return facts.select("id", "parent_id", parse.named_id(uuid.NAMESPACE_URL, name).alias("stable_id"))
