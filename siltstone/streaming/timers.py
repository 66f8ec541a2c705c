"""Lives of keys that change by events and by the passing of event time: jobs with leases and retries, presence that fades.

A ``Life`` says what an event and what a timer does to a key's state. ``live`` runs it as a stream: events wait in the
key's state until the watermark has passed them and are then applied in the order of (at, seq), with the timers that are
due between them, so the result doesn't depend on the order or the batches in which events came. A repeated event counts
once. One that comes after the watermark has passed it and its key has moved on is dropped. ``replay`` runs a life over a
bounded list, for tests.

State lies in RocksDB beside the checkpoint, so it outlives executors and restarts. What a key keeps is its state and the
events of the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

HOUR = 3_600_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What a life reports of a key: when (microseconds), its status from then on, and its attempt.
CHANGES = "key string, at long, status string, attempt int"
#: After every seq of an instant.
LAST = 2**63 - 1


class Life:
    """A state is a dict of plain values; each change is (at, status, attempt). Times are microseconds."""

    def event(self, state: dict, at: int, kind: str) -> list[tuple[int, str, int]]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When the state changes by itself, if no event comes before."""
        raise NotImplementedError

    def fire(self, state: dict) -> list[tuple[int, str, int]]:
        """What happens then; must move ``due`` on."""
        raise NotImplementedError


class Presence(Life):
    """An agent is what its last event says; without a new one it is idle after a day and offline after a week."""

    def __init__(self, idle: int = 24 * HOUR, offline: int = 7 * 24 * HOUR):
        self.idle, self.offline = idle, offline

    def event(self, state: dict, at: int, kind: str) -> list[tuple[int, str, int]]:
        changed = state.get("status") != kind
        state.update(status=kind, seen=at)
        return [(at, kind, 0)] if changed else []

    def due(self, state: dict) -> int | None:
        status = state.get("status")
        if status in (None, "offline"):
            return None
        return state["seen"] + (self.idle if status in ("online", "busy") and self.idle < self.offline else self.offline)

    def fire(self, state: dict) -> list[tuple[int, str, int]]:
        at = self.due(state)
        state["status"] = "idle" if at < state["seen"] + self.offline else "offline"
        return [(at, state["status"], 0)]


class Job(Life):
    """queued, started, beat, succeeded and failed move a job; others are passed over, as is a move that its state forbids.

    A running job holds a lease that each beat renews; when it runs out the job is orphaned. A failed or orphaned job
    waits ``wait`` times two for each attempt before and is queued again, up to ``most`` attempts; then it is given up.
    A job that has ended may be queued anew.
    """

    def __init__(self, lease: int = 6 * HOUR, wait: int = HOUR // 4, most: int = 3):
        self.lease, self.wait, self.most = lease, wait, most

    def event(self, state: dict, at: int, kind: str) -> list[tuple[int, str, int]]:
        status = state.get("status")
        if kind == "queued" and status in (None, "succeeded", "given_up"):
            state.update(status="queued", attempt=0, until=None)
        elif kind == "started" and status == "queued":
            state.update(status="running", attempt=state["attempt"] + 1, until=at + self.lease)
        elif kind == "beat" and status == "running":
            state["until"] = at + self.lease
            return []
        elif kind == "succeeded" and status == "running":
            state.update(status="succeeded", until=None)
        elif kind == "failed" and status == "running":
            return self._failed(state, at, "failed")
        else:
            return []
        return [(at, state["status"], state["attempt"])]

    def _failed(self, state: dict, at: int, how: str) -> list[tuple[int, str, int]]:
        attempt = state["attempt"]
        if attempt < self.most:
            state.update(status=how, until=at + self.wait * 2 ** (attempt - 1))
            return [(at, how, attempt)]
        state.update(status="given_up", until=None)
        return [(at, how, attempt), (at, "given_up", attempt)]

    def due(self, state: dict) -> int | None:
        return state.get("until")

    def fire(self, state: dict) -> list[tuple[int, str, int]]:
        at = state["until"]
        if state["status"] == "running":
            return self._failed(state, at, "orphaned")
        state.update(status="queued", until=None)
        return [(at, "queued", state["attempt"])]


def advance(life: Life, state: dict, events: Iterable[tuple[int, int, str]], until: int) -> Iterator[tuple[int, str, int]]:
    """Applies sorted events (at, seq, kind), and the timers between and after them, up to an instant, included. A timer
    comes before an event of the same instant. ``state["past"]`` is the last (at, seq) that was applied."""

    def timers(limit: int) -> Iterator[tuple[int, str, int]]:
        while (at := life.due(state)) is not None and at <= limit:
            yield from life.fire(state)
            state["past"] = [at, LAST] if at > state["past"][0] else state["past"]

    state.setdefault("past", [-LAST, 0])
    for at, seq, kind in events:
        yield from timers(at)
        yield from life.event(state, at, kind)
        state["past"] = [at, seq]
    yield from timers(until)


def replay(life: Life, events: Iterable[tuple[int, int, str]], until: int) -> list[tuple[int, str, int]]:
    """The changes of one key by all its events up to an instant."""
    return list(advance(life, {}, sorted({e for e in events if e[0] <= until}), until))


class Keeper(StatefulProcessor):
    """Runs a life for each key: waiting events in one list, the state in one value, one timer for what comes next. Events
    that can't be applied yet are added to the list at once and unread; it is read as a whole when one of them can."""

    def __init__(self, life: Life):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string")
        self.waiting = handle.getListState("events", "at long, seq long, kind string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        body = self._body()
        past = tuple(body.get("past", (-LAST, 0)))
        new = {(at, seq): kind for at, seq, kind in ((r["at"], r["seq"], r["kind"]) for r in rows) if (at, seq) > past}
        return self._settle(key, body, timerValues, new)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._settle(key, self._body(), timerValues, {})

    def close(self) -> None:
        pass

    def _body(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _settle(self, key: Any, body: dict, timer_values: Any, new: dict[tuple[int, int], str]) -> Iterator[Row]:
        until = timer_values.getCurrentWatermarkInMs() * 1000
        first, ready = min([at for at, _ in new] + [body[n] for n in ("first",) if n in body], default=None), []
        if first is not None and first <= until:
            known = {(at, seq): kind for at, seq, kind in self.waiting.get()} if "first" in body else {}
            events = sorted((at, seq, kind) for (at, seq), kind in (known | new).items())
            ready = [e for e in events if e[0] <= until]
            rest = events[len(ready) :]
            if rest:
                self.waiting.put(rest)
            elif known:
                self.waiting.clear()
            first = rest[0][0] if rest else None
        elif new:
            self.waiting.appendList([(at, seq, kind) for (at, seq), kind in new.items()])
        body.pop("first", None)
        out = [Row(key=key[0], at=at, status=status, attempt=attempt) for at, status, attempt in advance(self.life, body, ready, until)]
        due = self.life.due(body)
        if first is not None:
            body["first"] = first
        self.state.update((json.dumps(body),))
        nexts = [t for t in (due, first) if t is not None]
        wanted = -(-min(nexts) // 1000) if nexts else None
        there = list(self.handle.listTimers())
        for t in there:
            if t != wanted and t * 1000 > until:  # Spark itself ends a timer that has run out
                self.handle.deleteTimer(t)
        if wanted is not None and wanted not in there:
            self.handle.registerTimer(wanted)
        return iter(out)


def live(events: DataFrame, life: Life, late: str = "1 hour") -> DataFrame:
    """The changes (CHANGES) of a stream of events: key (string), time (timestamp), seq (long, unique among a key's events
    of one instant), kind (string). Rows without a key, time, seq or kind are passed over."""
    known = events.where("key is not null and time is not null and seq is not null and kind is not null")
    timed = known.select("key", "time", F.unix_micros("time").alias("at"), "seq", "kind").withWatermark("time", late)
    return timed.groupBy("key").transformWithState(Keeper(life), CHANGES, "Append", "EventTime")


def kept(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a job that appends the changes by all that is there now to a folder, each once, also across restarts."""
    spark = changes.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet")
    finally:
        spark.conf.set(PROVIDER, before)


def changes(spark: SparkSession, out: str) -> DataFrame:
    """What ``kept`` has written so far; a folder without a file yet is empty."""
    return spark.read.schema(CHANGES).parquet(out)
