"""The written entity table, and what a profile does to the score of a record."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval, search
from siltstone.operators.entity_table import BUCKETS, EntityTable

NOW = dt.datetime(2024, 2, 1)
RECORD = (
    "id long, type string, status string, kind string, title string, content string, tags array<string>, importance double, injected_count long, "
    "effectiveness_score double, feedback_score double, created_at timestamp_ntz, updated_at timestamp_ntz, vector_score double, boost double, sources array<string>"
)


def hits(spark, *rows):
    made = [(i, kind, "active", None, title, content, [], 0.5, 0, 0.5, 0.0, NOW, None, 0.6, 0.0, ["vector"]) for i, (kind, title, content) in enumerate(rows)]
    return spark.createDataFrame(made, RECORD)


def scores(records, **more):
    return {r.id: (r.score, r.asDict().get("conflict")) for r in retrieval.scored(records, "task", "2024-02-01 00:00:00", **more).collect()}


def test_a_profile_raises_and_discounts(spark):
    long = " plain words that make the text long enough for its full weight, whatever else it says or leaves out"
    rows = hits(
        spark, ("user_profile", "Editor", "Uses emacs." + long), ("user_profile", "Editor", "Uses VIM daily." + long), ("decision", "Editor", "Uses emacs." + long),
        ("user_profile", "Home", "Lives here." + long), ("user_profile", None, None), ("decision", "vim", "python and spark and vim." + long),
    )
    profile = spark.createDataFrame([("editor", "vim", 0.9), ("home", "the moon", 0.7), ("uses", "vim", 0.95)], "attribute string, value string, confidence double")
    plain = scores(rows)
    judged = scores(retrieval.contradicted(rows, profile), profile_words=("vim", "Python", "spark", "rust"))
    assert {i: c for i, (_, c) in judged.items()} == {0: "editor", 1: None, 2: None, 3: None, 4: None, 5: None}
    wanted = {i: s for i, (s, _) in plain.items()}
    wanted[0] *= 0.6
    wanted[1] += 0.15 / 3
    wanted[5] += 0.15
    assert {i: s for i, (s, _) in judged.items()} == pytest.approx(wanted)


def test_no_hits_and_no_profile(spark):
    none = hits(spark).where("false")
    profile = spark.createDataFrame([], "attribute string, value string, confidence double")
    assert scores(retrieval.contradicted(none, profile), profile_words=("a",)) == {}
    some = hits(spark, ("user_profile", "a", "b"))
    assert scores(retrieval.contradicted(some, profile))[0][1] is None


def test_entity_table(spark, tmp_path):
    rows = [(i, f"see /srv/x{i}.md and port 80{i % 10}", ["everywhere"] if i % 3 else ["Rare Name"]) for i in range(300)] + [(300, None, None), (301, "", ["everywhere"])]
    records = spark.createDataFrame(rows, "id long, content string, tags array<string>").repartition(4)
    table = EntityTable.build(records, f"{tmp_path}/entities")
    index = search.entity_index(records)
    for names in (["everywhere"], ["rare name", "803"], ["none"], ["it's"]):
        wanted = index.where(F.col("normalized_entity").isin(names))
        found = EntityTable(spark, f"{tmp_path}/entities").named(*names)
        assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert table.rows.drop("bucket").exceptAll(index.select(*table.rows.drop("bucket").columns)).count() == 0
    plan = table.named("everywhere")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    one = table.named("everywhere").select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1)).distinct()
    assert one.count() == 1 and table.rows.select("bucket").distinct().count() > BUCKETS // 2


def test_an_empty_entity_table(spark, tmp_path):
    EntityTable.build(spark.createDataFrame([], "id long, content string, tags array<string>"), f"{tmp_path}/none")
    assert EntityTable(spark, f"{tmp_path}/none").named("a").count() == 0
