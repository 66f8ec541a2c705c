"""How often a key's state is asked does not grow with its events."""

from __future__ import annotations

from types import SimpleNamespace

from siltstone.streaming import timers


class Counted:
    def __init__(self, calls: list):
        self.calls, self.value = calls, None

    def __getattr__(self, name: str):
        def call(*args):
            self.calls.append(name)
            if name == "exists":
                return self.value is not None
            if name in ("update", "put"):
                self.value = args[0]
            if name == "appendList":
                self.value = [*(self.value or []), *args[0]]
            if name == "clear":
                self.value = None
            return iter(self.value) if name == "get" and isinstance(self.value, list) else self.value

        return call


def test_waiting_events_take_few_calls():
    calls: list = []
    keeper = timers.Keeper(timers.Presence())
    keeper.init(SimpleNamespace(getValueState=lambda *a: Counted(calls), getListState=lambda *a: Counted(calls), getMapState=lambda *a: Counted(calls), listTimers=lambda: [], registerTimer=lambda t: None, deleteTimer=lambda t: None))
    events = [(i * timers.HOUR, i, "online" if i % 3 else "busy") for i in range(1, 1001)]
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(keeper.handleInputRows(("k",), iter([dict(at=a, seq=s, kind=k) for a, s, k in reversed([*events, *events])]), at(0))) == []
    until = 500 * timers.HOUR
    found = list(keeper.handleExpiredTimer(("k",), at(until // 1000), None)) + list(keeper.handleExpiredTimer(("k",), at(2 * until // 1000), None))
    assert [(r["at"], r["status"], r["attempt"]) for r in found] == timers.replay(timers.Presence(), events, 2 * until)
    assert len(calls) < 20
