"""A connector: server-sent events, or any lines of JSON, as micro-batches of a stream."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Iterator

from .writer import RECORD, StreamWriter


def events_of(lines: Iterable[str]) -> Iterator[tuple[str | None, dict]]:
    """(id, body) of every event of a server-sent-event feed: fields up to a blank line, data over
    several lines joined. Comments, other fields and bodies that are no JSON objects are left out."""
    ident, data = None, []
    for line in [*lines, ""] if isinstance(lines, list) else lines:
        line = line.rstrip("\r\n")
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "id":
            ident = value
        elif not line and data:
            try:
                body = json.loads("\n".join(data))
            except ValueError:
                body = None
            if isinstance(body, dict):
                yield ident, body
            data = []


def follow(feed: Iterable[tuple[str | None, dict]], writer: StreamWriter, *, key: Callable[[dict], str], time: Callable[[dict], float], partition: Callable[[str], int] = lambda key: 0, size: int = 200) -> int:
    """Publish a feed in batches of ``size`` events, each with the id of its last event as checkpoint,
    and return how many were new. A feed that begins again where it did before goes on after what the
    stream has: events count as offsets of the writer's source partition 0."""
    held, total, offset = [], 0, 0

    def publish() -> int:
        rows = [(partition(key(b)), dt.datetime.fromtimestamp(time(b), dt.UTC).replace(tzinfo=None), key(b), json.dumps(b, sort_keys=True), "insert", ident, 0, at) for at, ident, b in held]
        return writer.publish(writer.spark.createDataFrame(rows, RECORD), held[-1][1])

    due = writer.next_offset()
    for ident, body in feed:
        if offset >= due:
            held.append((offset, ident, body))
        offset += 1
        if len(held) == size:
            total += publish()
            held = []
    return total + (publish() if held else 0)
