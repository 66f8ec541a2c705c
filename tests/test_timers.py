"""Lives of jobs and agents as streams: out of order, repeated, late, and across a restart."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from siltstone.plans import QUERIES
from siltstone.plans.agents import JOB_EVENTS
from siltstone.streaming import jobs, timers
from siltstone.streaming.timers import HOUR, Job, Presence

START = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
SCHEMA = "key string, time timestamp, seq long, kind string"


def at(micros):
    return dt.datetime.fromtimestamp(micros / 1_000_000, dt.timezone.utc)


def file_of(spark, folder, name, events):
    """A file of one batch; files are read in the order in which they were written."""
    rows = [(key, at(t), seq, kind) for key, t, seq, kind in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, base, life, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    timers.kept(timers.live(stream, life, late), f"{base}/out", f"{base}/c").awaitTermination()


def found(spark, base):
    rows = timers.changes(spark, f"{base}/out").collect()
    return sorted((r.key, r.at, r.status, r.attempt) for r in rows)


def expected(life, events, until):
    keys = {k for k, *_ in events}
    return sorted((k, *c) for k in keys for c in timers.replay(life, [e[1:] for e in events if e[0] == k], until))


@pytest.mark.parametrize("life", [Job(), Presence()])
def test_any_order_and_a_restart_give_the_replay(spark, tmp_path, life):
    draw = random.Random(11)
    kinds = ["queued", "started", "beat", "succeeded", "failed"] if isinstance(life, Job) else ["online", "busy", "offline"]
    times = sorted(draw.sample(range(10 * 24 * 60), 300))
    events = [(f"k{draw.randrange(6)}", START + t * 60_000_000, i, draw.choice(kinds)) for i, t in enumerate(times)]
    closing = [("end", START + 11 * 24 * HOUR, 0, kinds[0])]
    shuffled = [e for _, e in sorted((i + draw.random() * 15, e) for i, e in enumerate(events))]
    base = str(tmp_path)
    for n, lo in enumerate(range(0, 300, 100)):
        part = shuffled[lo : lo + 100]
        file_of(spark, f"{base}/in", n, part + draw.sample(shuffled[max(0, lo - 5) : lo + 100], 20))
        run(spark, base, life, "2 days")
    file_of(spark, f"{base}/in", 9, closing)
    run(spark, base, life, "2 days")
    until = closing[0][1] - 2 * 24 * HOUR
    assert found(spark, base) == expected(life, events + closing, until)
    before = len(found(spark, base))
    run(spark, base, life, "2 days")
    assert len(found(spark, base)) == before > 20


def test_leases_retries_and_late_events(spark, tmp_path):
    base, life = str(tmp_path), Job(lease=2 * HOUR, wait=HOUR, most=2)
    file_of(spark, f"{base}/in", 0, [("a", START, 1, "queued"), ("a", START + HOUR, 2, "started"), ("b", START, 3, "started")])
    file_of(spark, f"{base}/in", 1, [("z", START + 24 * HOUR, 4, "queued")])
    run(spark, base, life, "1 hour")
    orphaned = [("a", START, "queued", 0), ("a", START + HOUR, "running", 1), ("a", START + 3 * HOUR, "orphaned", 1), ("a", START + 4 * HOUR, "queued", 1)]
    assert [r for r in found(spark, base) if r[0] != "z"] == sorted(orphaned)
    file_of(spark, f"{base}/in", 2, [("a", START + 2 * HOUR, 5, "beat"), ("a", START + 30 * HOUR, 6, "started"), (None, START, 7, "queued"), ("n", START, 8, None)])
    file_of(spark, f"{base}/in", 3, [("z", START + 60 * HOUR, 9, "queued")])
    run(spark, base, life, "1 hour")
    rest = [("a", START + 30 * HOUR, "running", 2), ("a", START + 32 * HOUR, "given_up", 2), ("a", START + 32 * HOUR, "orphaned", 2)]
    assert [r for r in found(spark, base) if r[0] != "z"] == sorted(orphaned + rest)


def test_replay_of_presence():
    out = timers.replay(Presence(), [(START, 1, "online"), (START, 1, "online"), (START + 24 * HOUR, 2, "online")], START + 400 * HOUR)
    assert [(t - START, s) for t, s, _ in out] == [
        (0, "online"), (24 * HOUR, "idle"), (24 * HOUR, "online"), (48 * HOUR, "idle"), (24 * 8 * HOUR, "offline"),
    ]
    assert timers.replay(Job(), [], START) == []


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in/0")
    run(spark, str(tmp_path), Job(), "1 hour")
    assert found(spark, str(tmp_path)) == []
    assert jobs.files(spark, f"{tmp_path}/in/0", spark.read.parquet(f"{tmp_path}/in/0").schema).isStreaming


def test_jobs_of_the_events_by_replay(spark, sf):
    events = [(f"{r.user_id}:{r.event_type}", r.at, r.event_id) for r in spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id", "event_type", "unix_micros(cast(ts AS timestamp)) AS at", "event_id").collect()]
    until = (max(t for _, t, _ in events) // 1000 * 1000) - HOUR
    by_rule = [(k, t, i, JOB_EVENTS[i % 5]) for k, t, i in events]
    got = sorted((r.key, r.since, r.status, r.attempt) for r in QUERIES["job_transitions"](spark, sf).collect())
    text = lambda t: str(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t))
    wanted = [(k, text(t), s, a) for k, t, s, a in expected(Job(lease=48 * HOUR, wait=HOUR), by_rule, until)]
    trimmed = lambda rows: [(k, t.rstrip("0") if "." in t else t, s, a) for k, t, s, a in rows]
    assert sorted(trimmed(got)) == sorted(trimmed(wanted)) and {s for *_, s, _ in wanted} >= {"orphaned", "failed", "queued"}
