"""Replicas compared by trees of digests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import hash_tree, maintenance
from siltstone.operators.hash_tree import HashTree, differing, differing_rows, drift


def tree(spark, path, rows, depth=3, digest=None):
    whole = F.struct("id", "status") if digest is None else digest
    return HashTree.build(spark.createDataFrame(rows, "id long, status string"), str(path), "id", whole, depth)


ROWS = [(i, "active" if i % 3 else None) for i in range(5000)]


def test_one_change_opens_one_node_a_level(spark, tmp_path):
    left = tree(spark, tmp_path / "l", ROWS)
    right = tree(spark, tmp_path / "r", [(i, "gone" if i == 77 else s) for i, s in ROWS][::-1])
    assert [d.count() for d in differing(left, right)] == [1, 1, 1, 1]
    one, other = differing_rows(left, right)
    assert 1 <= one.count() == other.count() < 20
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "top" in plan.split("PartitionFilters")[1].split("]")[0] and "In(leaf" in plan or "EqualTo(leaf" in plan
    assert [tuple(r) for r in drift(left, right, "id", ["id", "status"]).collect()] == [(77, "changed")]


def test_equal_replicas_stop_at_the_root(spark, tmp_path):
    left, right = tree(spark, tmp_path / "l", ROWS), tree(spark, tmp_path / "r", ROWS[::-1])
    assert [d.count() for d in differing(left, right)] == [0]
    assert drift(left, right, "id", ["id", "status"]).count() == 0


@pytest.mark.parametrize("listed", [3, 4096])
def test_drift_by_brute_force(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(hash_tree, "LISTED", listed)
    here = {i: s for i, s in ROWS if i % 97}
    there = {i: ("gone" if i % 101 == 0 else s) for i, s in ROWS if i % 89} | {9000: None}
    left, right = tree(spark, tmp_path / "l", list(here.items()), 2), tree(spark, tmp_path / "r", list(there.items()), 2)
    wanted = {i: "missing" for i in here.keys() - there.keys()} | {i: "extra" for i in there.keys() - here.keys()}
    wanted |= {i: "changed" for i in here.keys() & there.keys() if here[i] != there[i]}
    assert {r.id: r.what for r in drift(left, right, "id", ["id", "status"]).collect()} == wanted


def test_rows_that_do_not_count_are_there_to_be_judged(spark, tmp_path):
    rows = [(i, "active" if i % 2 else "archived") for i in range(1000)]
    indexed = [(i, "x") for i in range(1, 1000, 2) if i != 501] + [(500, "x"), (5000, "x")]
    live = F.when(F.col("status") == "active", F.col("id"))
    left, right = tree(spark, tmp_path / "l", rows, 2, live), tree(spark, tmp_path / "r", indexed, 2, F.col("id"))
    found = maintenance.reconciled(*differing_rows(left, right))
    assert {r.id: r.reason for r in found.collect()} == {501: "missing", 500: "inactive", 5000: "orphan"}


def test_repeated_empty_and_unlike_trees(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (None, None)]
    left, right = tree(spark, tmp_path / "l", rows), tree(spark, tmp_path / "r", rows + [(1, "a"), (1, "a")])
    assert [d.count() for d in differing(left, right)] == [1, 1, 1, 1]
    none = tree(spark, tmp_path / "n", [])
    assert {r.id: r.what for r in drift(tree(spark, tmp_path / "m", rows[:2]), none, "id", ["id"]).collect()} == {1: "missing", 2: "missing"}
    assert differing(none, tree(spark, tmp_path / "o", [])) == [] and drift(none, none, "id", ["id"]).count() == 0
    with pytest.raises(ValueError, match="depths"):
        differing(left, tree(spark, tmp_path / "d", rows, 2))
    assert [hash_tree.depth_of(n) for n in (0, 65_536, 65_537, 10**12)] == [1, 1, 2, 6]
