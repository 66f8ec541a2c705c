"""Records' rules on small tables: nulls, ties and the edges of each rule."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from siltstone.operators import records

AS_OF = "2024-02-01 00:00:00"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def test_status_goes_down_to_atomic_facts_only(spark):
    m = spark.createDataFrame(
        [(1, "active", "parent_memory", None), (2, "active", "atomic_fact", 1), (3, "active", "plain", 1), (4, "stale", "atomic_fact", 1), (5, None, None, None)],
        "id long, status string, kind string, parent_id long",
    ).withColumn("updated_at", F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz"))
    change = spark.createDataFrame([(1, "archived"), (4, "active")], "id long, new_status string")
    assert [r[1] for r in rows(records.with_status(m, change, AS_OF).select("id", "status"))] == ["archived", "archived", "active", "active", None]
    back = spark.createDataFrame([(1, "active")], "id long, new_status string")
    assert [r[1] for r in rows(records.with_status(m, back, AS_OF).select("id", "status"))] == ["active", "active", "active", "stale", None]


def test_supersession_guards(spark):
    m = spark.createDataFrame(
        [(1, "active", None, None), (2, "active", None, None), (3, "archived", None, None), (4, "superseded", 9, None), (5, "active", None, 7), (6, "active", None, 5)],
        "id long, status string, superseded_by long, fact_lineage_root long",
    )
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (3, 1), (4, 1), (1, 4), (8, 1), (1, 8), (1, 5), (5, 6), (6, 2)], "old_id long, new_id long")
    found = {(o, n): (e, r) for o, n, e, r in rows(records.supersession_errors(m, pairs))}
    assert found[1, 2] == (None, 1) and found[6, 2] == (None, 5)
    assert found[1, 1][0] == "same record" and found[8, 1][0] == "old record not found" and found[1, 8][0] == "new record not found"
    assert found[3, 1][0] == "old record is archived" and found[1, 3][0] == "new record is archived"
    assert found[4, 1][0] == "old record already superseded" and found[1, 4][0] == "new record already superseded"
    assert found[1, 5][0] == "lineages differ" and found[5, 6][0] == "lineages differ"


def test_typing_and_texts(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(records.typed(F.lit(None), F.lit("必须"), F.lit(None))) == "decision"
    assert value(records.typed(F.lit(""), F.lit("x"), F.lit("the PORT is 1"))) == "environment_fact"
    assert value(records.typed(F.lit("feedback"), F.lit("必须"), F.lit(""))) == "feedback"
    assert value(records.typed(F.lit("general"), F.lit("q"), F.lit("q"))) == "general"
    assert value(records.typed(F.lit(None), F.lit(None), F.lit(None))) == "episodic_memory"
    assert value(records.ideograph_share(F.lit(""))) == 0 and value(records.ideograph_share(F.lit("一二ab"))) == 0.5
    assert value(records.masked(F.lit(None))) == "" and value(records.masked(F.lit("12345678"))) == "****"
    assert value(records.masked(F.lit("abcdefghij"))) == "abc****ghij"
    assert value(records.title_subject(F.lit("[A-b] c"))) == ["a", "a-b"] and value(records.title_subject(F.lit(None))) == []
    assert value(records.overlap(F.lit(None), ["a"])) == 0 and value(records.overlap(F.lit("ABCD"), ["a", "b", "c", "d"])) == 1


def test_generic_prompts_are_skipped(spark):
    asked = spark.createDataFrame(
        [(1, "codex", "help me"), (2, "gemini", "help me"), (3, "codex", "helpless"), (4, "gemini", "abc"), (5, None, None), (6, "codex", "help me to write a long story")],
        "id long, agent string, prompt string",
    )
    assert [r[1] for r in rows(asked.select("id", records.is_generic(F.col("agent"), F.col("prompt")).alias("g")))] == [True, False, False, True, True, False]


def test_uses_without_records_and_records_without_uses(spark):
    m = spark.createDataFrame([(1, 2, None, None), (2, 0, None, None)], "id long, injected_count long, last_injected_at timestamp, last_accessed_at timestamp")
    uses = spark.createDataFrame([(1, "injected", datetime(2024, 1, 2)), (1, "injected", datetime(2024, 1, 1)), (1, "last_accessed", datetime(2024, 1, 3)), (9, "injected", None)], "id long, kind string, ts timestamp")
    assert rows(records.used(m, uses)) == [(1, 4, datetime(2024, 1, 2), datetime(2024, 1, 3)), (2, 0, None, None)]
    assert rows(records.used(m, uses.limit(0))) == [(1, 2, None, None), (2, 0, None, None)]


def test_maintenance_candidates_with_nulls(spark):
    old = datetime(2023, 1, 1)
    m = spark.createDataFrame(
        [(1, None, "c", "active", None, old), (2, "T ", "c", "active", 0.1, old), (3, "t", " ", "active", 0.9, old), (4, "t", "c", "superseded", 0.9, None), (5, "", "", "archived", 0.0, old)],
        "id long, title string, content string, status string, importance double, updated_at timestamp_ntz",
    )

    def ids(action):
        return [r.id for r in records.maintenance_candidates(m, action, AS_OF).orderBy("id").collect()]

    assert ids("clean") == [1, 3] and ids("dedup") == [2, 3] and ids("expire") == [] and ids("archive") == [1, 2]
