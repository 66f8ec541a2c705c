"""Exports by kind, backups and the three layouts of transcripts."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from siltstone.sources import transfer


def lines(folder, **files):
    folder.mkdir()
    for name, rows in files.items():
        (folder / f"{name}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(folder)


def said(found):
    return [(r.role, r.text) for r in sorted(found.collect(), key=lambda r: (r.file, r.line))]


def test_messages(spark, tmp_path):
    long = "x" * 5000
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"}, {"text": "b"}, {"type": "text", "text": ""}]
    path = lines(tmp_path / "m", one=[
        {"type": "user", "message": {"role": "user", "content": f" {long}\n"}}, {"message": {"role": "assistant", "content": blocks}},
        "not json", {"role": "user", "content": "[not blocks"}, {"role": "system", "content": "s"}, {"role": "user", "content": " "},
        {"role": "user"}, {"role": "assistant", "content": []},
    ])
    assert said(transfer.transcripts(spark, path)) == [("user", long), ("assistant", "a b"), ("user", "[not blocks")]
    assert said(transfer.transcripts(spark, path, chars=3))[0] == ("user", "xxx")
    with pytest.raises(ValueError):
        transfer.transcripts(spark, path, "other")


def test_events_come_before_response_items(spark, tmp_path):
    event = lambda kind, text: {"type": "event_msg", "payload": {"type": kind, "message": text}}
    item = lambda role, *parts: {"type": "response_item", "payload": {"type": "message", "role": role, "content": list(parts)}}
    path = lines(
        tmp_path / "e",
        a=[event("user_message", "q"), item("user", {"input_text": "q"}), event("token_count", "9"), event("agent_message", "r")],
        b=[item("user", {"input_text": "u"}, {"text": "v"}), item("assistant", {"output_text": "w"}), item("developer", {"text": "d"}), event("user_message", " ")],
    )
    assert said(transfer.transcripts(spark, path, "events")) == [("user", "q"), ("assistant", "r"), ("user", "u v"), ("assistant", "w")]


def test_turns(spark, tmp_path):
    path = lines(tmp_path / "t", a=[
        {"role": "", "author": "user", "text": "t"}, {"type": "gemini", "content": [{"text": "c"}]},
        {"speaker": "model", "displayContent": "shown", "content": "hidden"}, {"role": "info", "text": "i"}, {"role": "user", "message": "m"},
    ])
    assert said(transfer.transcripts(spark, path, "turns")) == [("user", "t"), ("assistant", "c"), ("assistant", "shown"), ("user", "m")]


def test_sets_and_snapshots(spark, tmp_path):
    tables = {"memories": spark.range(3), "memory_entities": spark.range(2), "audit_events": spark.range(4), "other": spark.range(9)}
    counts = lambda *a: [tuple(r) for r in transfer.export_set(tables, str(tmp_path / "x"), *a).collect()]
    assert counts("sync", True) == [("memories", 3), ("feedback_events", 0), ("memory_links", 0), ("memory_entities", 2)]
    assert counts("transfer", True)[0] == ("memories", 3) and counts("transfer", True)[-1] == ("audit_events", 4)
    assert len(counts("full")) == 15 and not (tmp_path / "x" / "other").exists()
    transfer.snapshot(tables, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "other")).count() == 9
    with pytest.raises(AnalysisException):
        transfer.snapshot(tables, str(tmp_path / "s"))
    empty = transfer.write_archive(spark.range(0), str(tmp_path / "a"), "t", "b").first()
    assert empty["rows"] == 0 and empty["chars"] == 0
