"""Judges asked once for each question, across restarts."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from siltstone.operators import judging
from siltstone.operators.judging import Judgements, curated


def judge_of(log, fail_on=None):
    """Keeps the longer text; writes down each prompt that it is asked."""

    def judge(prompts):
        out = []
        for p in prompts:
            pair = json.loads(p)
            a, b = pair["a"], pair["b"]
            if fail_on is not None and fail_on in (a["id"], b["id"]):
                raise RuntimeError("the judge is gone")
            with open(f"{log}/{a['id']}-{b['id']}", "a") as f:
                f.write("x")
            if a["content"] is None:
                out.append(None)
            elif a["id"] == 9:
                out.append("no idea")
            elif a["id"] == 8:
                out.append('{"action": "merge", "keep": 1}')
            else:
                longer = a if len(a["content"]) >= len(b["content"] or "") else b
                out.append('<think>{}</think> ```json\n' + json.dumps({"action": "merge", "keep": longer["id"], "reason": "longer"}) + "\n```")
        return out

    return judge


@pytest.fixture
def data(spark):
    records = spark.createDataFrame([(i, "decision", f"t{i}", "x" * (i * 7 % 11) if i != 7 else None) for i in range(40)], "id long, type string, title string, content string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 38)] + [(1, 0), (0, 1), (5, 5), (3, 99)], "a long, b long")
    return pairs, records


def calls(log):
    return {p.name: len(p.read_text()) for p in Path(log).iterdir()}


def test_a_run_that_ends_after_any_batch_asks_nothing_twice(spark, data, tmp_path):
    pairs, records = data
    log = tmp_path / "log"
    log.mkdir()
    parts = []
    for _ in range(4):
        store = Judgements(spark, f"file://{tmp_path}/j", "v1")
        parts.append(curated(pairs, records, store, judge_of(log), budget=900, calls=3, most=2).where("state <> 'open'").count())
    assert parts == sorted(parts) and parts[0] < parts[-1]
    found = {(r.a, r.b): r for r in curated(pairs, records, Judgements(spark, f"file://{tmp_path}/j", "v1"), judge_of(log), budget=900).collect()}
    assert set(found) == {(i, i + 1) for i in range(38)}
    assert {k for k, r in found.items() if r.state == "open"} == {(7, 8)} and {k for k, r in found.items() if r.state == "invalid"} == {(8, 9), (9, 10)}
    for (a, b), r in found.items():
        if r.state == "judged":
            keep = a if a * 7 % 11 >= (b * 7 % 11 if b != 7 else 0) else b
            assert (r.action, r.keep, r.drop, r.reason) == ("merge", keep, a + b - keep, "longer")
    assert {n for n, c in calls(log).items() if c > 1} <= {"7-8"} and len(calls(log)) == 38


def test_a_judge_that_fails_keeps_what_was_answered(spark, data, tmp_path):
    pairs, records = data
    log = tmp_path / "log"
    log.mkdir()
    store = Judgements(spark, f"file://{tmp_path}/j")
    with pytest.raises(Exception, match="the judge is gone"):
        curated(pairs, records, store, judge_of(log, 20), budget=300)
    before = store.replies().count()
    whole = curated(pairs, records, store, judge_of(log), budget=300)
    assert whole.where("state = 'judged'").count() == 35 and before <= 37
    assert curated(pairs, records, Judgements(spark, f"file://{tmp_path}/j", "new"), judge_of(log), most=0).where("state = 'open'").count() == 38


def test_no_pairs_and_wrong_numbers_of_answers(spark, data, tmp_path):
    pairs, records = data
    store = Judgements(spark, f"file://{tmp_path}/j")
    assert curated(pairs.where("false"), records, store, judge_of(tmp_path)).count() == 0
    with pytest.raises(Exception, match="0 answers"):
        curated(pairs, records, store, lambda prompts: [])
    assert store.replies().count() == 0


def test_prompts_are_stored_once_and_repeated_ones_asked_once(spark, data, tmp_path, monkeypatch):
    pairs, records = data
    stored = []
    keep = judging.written
    monkeypatch.setattr(judging, "written", lambda df, name="table": stored.append("prompt" in df.columns) or keep(df, name))
    log = tmp_path / "log"
    log.mkdir()
    store = Judgements(spark, f"file://{tmp_path}/j")
    again = records.where("id between 10 and 12")
    assert curated(pairs.where("a between 9 and 14"), records.unionByName(again), store, judge_of(log), budget=500).where("state <> 'open'").count() == 14
    assert sum(stored) == 1 and len(calls(log)) == 6 and set(calls(log).values()) == {1}
