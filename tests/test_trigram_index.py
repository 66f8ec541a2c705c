"""The written trigram index against scans of all records: same rows, from the buckets of the query alone."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.operators.trigram_index import TrigramIndex
from siltstone.sources.scratch import shared_folder

KIND = "id long, title string, content string, tags array<string>, importance double, effectiveness_score double, feedback_score double, updated_at timestamp"


@pytest.fixture(scope="module")
def records(spark):
    words = "Postgres pgvector index über 数据库 连接池 retry-queue the of latency cache MCP x9 port 8080 100%_sure".split()
    rows = []
    for i in range(240):
        title = " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 5))
        body = " ".join(words[(i + 3 * k) % len(words)] for k in range(i % 17))
        rows.append((i, title, body, [words[i % 7]], i % 11 / 10, i % 7 / 7, i % 3 - 1.0, None))
    rows += [(900, None, None, None, 0.5, 0.5, 0.0, None), (901, "", "", [], 0.5, 0.5, 0.0, None), (902, "x", "9", None, 0.5, 0.5, 0.0, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def index(spark, records):
    return TrigramIndex.build(records, f"{shared_folder(spark)}/{uuid.uuid4().hex}", bucket=400)


@pytest.mark.parametrize("query", ["pgvector latency", "数据库 连接池", "über", "mcp x9", "postgers indx", "zzzz qqqq", "", "100%_sure", "the of"])
def test_searches_give_the_rows_of_a_scan(records, index, query):
    assert index.ranked(query, 50).collect() == search.ranked(records, query, 50).collect()
    if search.search_terms(query):
        assert index.relaxed(query).collect() == search.relaxed(records, query).collect()
    if query:
        assert index.hybrid(query).collect() == search.hybrid(records, query, None).collect()


def test_a_search_reads_the_buckets_of_its_trigrams_alone(spark, records, index):
    index.buckets_read.clear()
    index.ranked("pgvector")
    every = index.postings.select("bucket").distinct().count()
    assert 0 < len(index.buckets_read) < every / 2
    rarest = index.grams.where("kind = 'text'").orderBy("postings", "gram").limit(2)
    found = index._of("text", rarest)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_thresholds_are_exact(spark, records, index):
    for least in (0.03, 0.15, 0.5):
        from siltstone.functions import text

        want = records.where(text.similarity(F.col("title"), F.lit("pgvector index")) > least)
        assert {r.id for r in index.alike("pgvector index", least).collect()} == {r.id for r in want.collect()}


def test_an_empty_table(spark, records):
    none = TrigramIndex.build(records.limit(0), f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    assert none.ranked("pgvector").count() == 0 and none.relaxed("pgvector").count() == 0
