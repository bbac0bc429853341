"""State processors for ``transformWithState``."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def millis(t: dt.datetime) -> int:
    return round(t.timestamp() * 1000)


def micros(t: dt.datetime) -> int:
    return round(t.timestamp() * 1_000_000)


def from_micros(us: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(us / 1_000_000)


class FirstByTime(StatefulProcessor):
    """Keeps the least (time, sequence) of a key until the watermark passes it; then the key is done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "us long, sequence long, body string, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        held = self.best.get() if self.best.exists() else None
        if held is not None and held[3]:
            return
        before = held
        for row in rows:
            mine = (micros(row.event_time), row.sequence, row.body, False)
            if held is None or mine[:2] < tuple(held)[:2]:
                held = mine
        if held is not before:
            if before is not None:
                self.handle.deleteTimer(-(-before[0] // 1000))
            self.best.update(tuple(held))
            self.handle.registerTimer(-(-held[0] // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        us, sequence, body, done = self.best.get()
        if not done:
            self.best.update((us, sequence, body, True))
            yield Row(key=key[0], event_time=from_micros(us), sequence=sequence, body=body)

    def close(self) -> None:
        pass


class AsOfJoin(StatefulProcessor):
    """Buffers probes until the watermark reaches them, and versions while a probe may need them."""

    def __init__(self, how: str):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.probes = handle.getListState("probes", "us long, sequence long, body string")
        self.versions = handle.getListState("versions", "us long, sequence long, body string, gone boolean")

    def handleInputRows(self, key, rows, timerValues):
        for row in rows:
            us = micros(row.event_time)
            if row.is_probe:
                self.probes.appendValue((us, row.sequence, row.body))
                self.handle.registerTimer(-(-us // 1000))
            else:
                self.versions.appendValue((us, row.sequence, row.body, row.kind in ("delete", "update_before")))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        through = expiredTimerInfo.getExpiryTimeInMs() * 1000
        versions = sorted(tuple(v) for v in self.versions.get())
        due, rest = [], []
        for p in self.probes.get():
            (due if p[0] <= through else rest).append(tuple(p))
        for us, _, body in sorted(due):
            held = [v for v in versions if v[0] <= us]
            match = held[-1] if held and not held[-1][3] else None
            if match or self.how == "left":
                yield Row(key=key[0], event_time=from_micros(us), probe=body, version=match[2] if match else None)
        self.probes.put(rest) if rest else self.probes.clear()
        # The newest version at or before the frontier serves all later probes.
        old = [v for v in versions if v[0] <= through]
        kept = versions[len(old) - 1 :] if old else versions
        if kept:
            self.versions.put(kept)

    def close(self) -> None:
        pass


class KeyedFold(StatefulProcessor):
    """A process's handler over the records of a key, with versioned state."""

    def __init__(self, process):
        self.process = process

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "version int, body string")

    def handleInputRows(self, key, rows, timerValues):
        p = self.process
        if self.state.exists():
            version, body = self.state.get()
            state = p.upgraded(json.loads(body), version)
        else:
            state = json.loads(json.dumps(p.initial))
        for row in sorted(rows, key=lambda r: r.sequence):
            emitted, error = None, None
            for _ in range(p.max_attempts):
                try:
                    state, emitted = p.handler(json.loads(json.dumps(state)), json.loads(row.body))
                    error = None
                    break
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            yield Row(key=key[0], sequence=row.sequence, state=json.dumps(state, sort_keys=True), emitted=None if error or emitted is None else json.dumps(emitted, sort_keys=True), error=error)
        self.state.update((p.version, json.dumps(state)))

    def close(self) -> None:
        pass


class RetractableMax(StatefulProcessor):
    """Counts of values by key; emits the changes of the largest value with a positive count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "value double", "n long")
        self.top = handle.getValueState("top", "value double")

    def handleInputRows(self, key, rows, timerValues):
        for row in sorted(rows, key=lambda r: r.sequence):
            k = (row.value,)
            n = (self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0) + row.diff
            if n < 0:
                raise ValueError(f"{row.value} was retracted more often than it was added")
            self.counts.updateValue(k, (n,)) if n else self.counts.removeKey(k)
            old = self.top.get()[0] if self.top.exists() else None
            new = old
            if row.diff > 0 and (old is None or row.value > old):
                new = row.value
            elif n == 0 and row.value == old:
                left = [v[0] for v in self.counts.keys()]
                new = max(left) if left else None
            if new == old:
                continue
            out = lambda kind, v, s=row.sequence: Row(key=key[0], sequence=s, kind=kind, value=v)
            if old is None:
                yield out("insert", new)
            elif new is None:
                yield out("delete", old)
            else:
                yield out("update_before", old)
                yield out("update_after", new)
            self.top.update((new,)) if new is not None else self.top.clear()

    def close(self) -> None:
        pass
