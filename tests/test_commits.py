"""Versioned tables and governed changes: compare-and-set, drift, rollback, batches, commits that die."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import commits
from siltstone.sources.scratch import shared_folder
from siltstone.sources.versions import Conflict, VersionedTable

KIND = "id long, status string, note string"


@pytest.fixture
def table(spark):
    rows = spark.createDataFrame([(i, "active", None if i % 3 else "n") for i in range(40)], KIND)
    return VersionedTable.create(rows, f"{shared_folder(spark)}/{uuid.uuid4().hex}", buckets=8)


def states(df):
    return {r.id: r.status for r in df.collect()}


def archive(spark, ids):
    return spark.createDataFrame([(i, "archived") for i in ids], "id long, status string")


def test_a_commit_touches_its_buckets_alone(spark, table):
    before = table.entry()["parts"]
    rows = spark.createDataFrame([(3, "stale", "x"), (100, "active", None)], KIND)
    assert table.put(0, rows, archive(spark, [5]).select("id")) == 1
    after = table.entry()["parts"]
    touched = {r[0] for r in spark.createDataFrame([(3,), (100,), (5,)], "id long").select(table.bucket_of(table.entry(), F.col("id"))).collect()}
    assert {b for b in range(8) if before[b] != after[b]} == touched
    got = states(table.read())
    assert got[3] == "stale" and got[100] == "active" and 5 not in got and len(got) == 40
    assert states(table.read(0)) == dict.fromkeys(range(40), "active")
    assert table.restore(0) == 2 and states(table.read()) == states(table.read(0))


def test_of_two_commits_on_one_version_the_second_is_refused(spark, table):
    table.put(0, spark.createDataFrame([(1, "a", None)], KIND))
    with pytest.raises(Conflict):
        table.put(0, spark.createDataFrame([(2, "b", None)], KIND))
    assert table.version == 1 and states(table.read())[2] == "active"


def test_a_killed_commit_leaves_the_version_before(spark, table, monkeypatch):
    def killed(self, version, entry):
        raise RuntimeError("killed")

    monkeypatch.setattr(VersionedTable, "_publish", killed)
    with pytest.raises(RuntimeError):
        table.put(0, spark.createDataFrame([(1, "a", None)], KIND))
    monkeypatch.undo()
    table._fs.create(table._at("log", "left.draft"), True).close()
    assert table.version == 0 and states(table.read())[1] == "active"
    assert table.put(0, spark.createDataFrame([(1, "a", None)], KIND)) == 1


def test_plans_drift_replay_and_rollback(spark, table):
    one, two = commits.plan(table, archive(spark, range(5)), "clean"), commits.plan(table, archive(spark, range(3, 8)), "clean")
    far = commits.plan(table, archive(spark, [30]), "clean")
    assert commits.execute(table, "no such token")["error"] == "unknown_plan_token"
    assert commits.execute(table, one) == {"ok": True, "idempotent": False, "version": 1, "changed": 5}
    assert commits.execute(table, one) == {"ok": True, "idempotent": True, "version": 1, "changed": 5}
    assert [commits.execute(table, t)["error"] for t in (two, far)] == ["plan_drift"] * 2
    assert commits.execute(table, two, strict=False)["error"] == "plan_drift"
    assert commits.execute(table, far, strict=False)["version"] == 2
    assert sorted(i for i, s in states(table.read()).items() if s == "archived") == [0, 1, 2, 3, 4, 30]
    assert {r.entity for r in commits.ledger(table, 1).where("before like '%active%' and after like '%archived%'").collect()} == set(range(5))
    assert commits.rollback(table, 1)["changed"] == 5 and commits.rollback(table, 1)["idempotent"]
    assert sorted(i for i, s in states(table.read()).items() if s == "archived") == [30]
    assert {r.version: r.status for r in commits.ledger(table).collect()} == {1: "rolled_back", 2: "applied", 3: "applied"}
    table.put(table.version, spark.createDataFrame([(30, "stale", None)], KIND))
    assert commits.rollback(table, 2)["error"] == "plan_drift" and commits.rollback(table, 0)["error"] == "no_execution_record"


def test_batches(spark, table):
    kind = "id long, action string, risk_level string, confidence double, review_status string, first_id long, second_id long"
    rows = [(1, "archive", "low", 0.9, "needs_review", 0, 1), (2, "mark_contradicted", "low", 0.9, "auto_approved", 2, 9), (3, "archive", "low", 0.3, "needs_review", 0, 3),
            (4, "archive", "low", 0.9, "applied", 0, 4), (5, "archive", "low", 0.9, "rejected", 0, 5), (6, "archive_duplicate", "low", 0.9, "auto_approved", 0, 777)]
    decisions = VersionedTable.create(spark.createDataFrame(rows, kind), f"{shared_folder(spark)}/{uuid.uuid4().hex}", buckets=4)
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id long")
    assert commits.apply_batch(table, decisions, ids(1, 5))["error"] == "invalid_state"
    assert commits.apply_batch(table, decisions, ids(1, 50))["error"] == "missing"
    assert table.version == decisions.version == 0
    assert commits.apply_batch(table, decisions, ids(3))["skipped_run"]
    got = commits.apply_batch(table, decisions, ids(1, 2, 3, 4, 6, 1))
    assert (got["applied_count"], got["skipped_count"], got["already_applied"], got["changed"]) == (3, 1, 1, 2)
    assert {i: s for i, s in states(table.read()).items() if s != "active"} == {1: "archived", 2: "contradicted"}
    assert {r.id for r in decisions.read().where("review_status = 'applied'").collect()} == {1, 2, 4, 6}


def test_a_batch_that_died_between_its_commits_is_finished(spark, table, monkeypatch):
    kind = "id long, action string, risk_level string, confidence double, review_status string, first_id long, second_id long"
    decisions = VersionedTable.create(spark.createDataFrame([(1, "archive", "low", 0.9, "needs_review", 0, 1)], kind), f"{shared_folder(spark)}/{uuid.uuid4().hex}", buckets=2)
    asked, plain = spark.createDataFrame([(1,)], "id long"), commits._commit

    def dies(table_, *rest):
        if table_ is decisions:
            raise RuntimeError
        return plain(table_, *rest)

    monkeypatch.setattr(commits, "_commit", dies)
    with pytest.raises(RuntimeError):
        commits.apply_batch(table, decisions, asked)
    monkeypatch.undo()
    assert states(table.read())[1] == "archived" and decisions.version == 0
    commits.apply_batch(table, decisions, asked)
    assert table.version == 1 and decisions.read().first().review_status == "applied"
