"""Keyed processes: a state per key, folded over its records in admission order.

``fold`` runs a user's handler over the records of each key. Keys are dealt out by one exchange and
sorted within their partition; a task streams through them and holds the state of one key at a time,
so a key of any number of records needs no more memory than its state.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require
from .joins import as_of

OUTCOME = "status string, attempts int, backoff double, state string, emitted string, error string"


@dataclass(frozen=True)
class Process:
    """A handler ``(state, record) -> (state, emitted)`` over JSON-like values.

    ``version`` and ``migrations`` (from version n to n + 1) upgrade stored states; a state newer than
    the code, or a missing step, is an error. A record that fails ``max_attempts`` times goes to
    quarantine and leaves the state as it was.
    """

    name: str
    handler: Callable
    initial: dict = field(default_factory=dict)
    version: int = 1
    migrations: dict[int, Callable] = field(default_factory=dict)
    max_attempts: int = 5

    def __post_init__(self):
        if self.version < 1 or self.max_attempts < 1:
            raise ValueError("version and max_attempts are at least 1")
        if any(not 1 <= v < self.version for v in self.migrations):
            raise ValueError("a migration starts from an earlier version")

    @property
    def build(self) -> str:
        """A hash of the handler's code: two builds with the same behaviour-defining code agree."""
        digest = hashlib.sha256()

        def add(code):
            digest.update(code.co_code)
            digest.update(repr((code.co_names, code.co_varnames)).encode())
            for const in code.co_consts:
                if hasattr(const, "co_code"):
                    add(const)
                else:
                    digest.update(repr(const).encode())

        for step in [self.handler, *[self.migrations[k] for k in sorted(self.migrations)]]:
            add(step.__code__)
        digest.update(json.dumps([self.name, self.version, self.initial], sort_keys=True).encode())
        return digest.hexdigest()

    def upgraded(self, state: dict, version: int) -> dict:
        if version > self.version:
            raise ValueError(f"a state of version {version} is newer than {self.version}")
        for v in range(version, self.version):
            if v not in self.migrations:
                raise ValueError(f"no migration from version {v}")
            state = self.migrations[v](state)
        return state


def backoff(attempts: int) -> float:
    """Seconds to wait after so many failed attempts."""
    return min(5.0, 0.1 * 2 ** (attempts - 1)) if attempts else 0.0


class Running:
    """A process at one key: its live state, and the JSON of the state that was last committed."""

    def __init__(self, process: Process, held: str | None, version: int | None):
        self.process = process
        self.state = process.upgraded(json.loads(held), version or 1) if held else json.loads(json.dumps(process.initial))
        self.body = json.dumps(self.state, sort_keys=True)

    def step(self, record: dict) -> tuple:
        """(status, attempts, backoff, state, emitted, error). A failed attempt may have touched the
        live state, which then comes from the committed one again."""
        attempts, waited = 0, 0.0
        while True:
            attempts += 1
            try:
                state, emitted = self.process.handler(self.state, record)
                self.state, self.body = state, json.dumps(state, sort_keys=True)
                return "COMMITTED", attempts, waited, self.body, None if emitted is None else json.dumps(emitted, sort_keys=True), None
            except Exception as e:
                self.state = json.loads(self.body)
                if attempts >= self.process.max_attempts:
                    return "FAILED", attempts, waited, self.body, None, f"{type(e).__name__}: {e}"
                waited += backoff(attempts)


def gated(records: DataFrame, gate: str, frontier_us: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(records that may run, those that wait): ``complete`` lets in what is at or before the frontier,
    and nothing while there is none."""
    if gate == "immediate":
        return records, None
    if gate != "complete":
        raise ValueError(f"unknown gate {gate!r}")
    ready = F.lit(False) if frontier_us is None else F.unix_micros(F.col("event_time").cast("timestamp")) <= frontier_us
    return records.filter(ready), records.filter(~F.coalesce(ready, F.lit(False)))


def fold(records: DataFrame, process: Process | list[Process], *, key: str = "key", order: str = "sequence", frontier_us: int | None = None, gate: str = "immediate", final_keys: DataFrame | None = None, states: DataFrame | None = None, waiting: bool = False) -> DataFrame:
    """Every record with its outcome: ``status`` (COMMITTED, FAILED), ``attempts``, the total
    ``backoff``, ``state`` after it and what it ``emitted`` (both JSON), and the ``error``.

    ``gate='complete'`` runs only records at or before the frontier; with ``waiting``, the others are
    there too, as PENDING. Records of ``final_keys`` are refused. ``states`` has ``key``, ``state``
    (JSON) and ``version`` to go on from. Of several processes, which run side by side over one
    exchange, each has an array entry in ``outcomes`` instead.
    """
    several = isinstance(process, list)
    processes = process if several else [process]
    rows = require(records, F.col(key).isNotNull() & (F.col(key).cast("string") != ""), "a process needs a key")
    rows, late = gated(rows, gate, frontier_us)
    if final_keys is not None:
        rows = rows.join(final_keys.select(F.col(key)).distinct(), key, "left_anti")
    names = list(rows.columns)
    if states is not None:
        held = states.select(F.col("key").alias("_k"), F.col("state").alias("_state"), F.col("version").alias("_version"))
        rows = rows.join(held, F.col(key) == F.col("_k"), "left").drop("_k")
    else:
        rows = rows.withColumn("_state", F.lit(None).cast("string")).withColumn("_version", F.lit(None).cast("int"))
    kind = pa.struct([("status", pa.string()), ("attempts", pa.int32()), ("backoff", pa.float64()), ("state", pa.string()), ("emitted", pa.string()), ("error", pa.string())])
    fields = [f.name for f in kind]

    def run(batches):
        now, live = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                held, version = row.pop("_state"), row.pop("_version")
                if now is None or row[key] != now:
                    now = row[key]
                    live = [Running(p, held, version) for p in processes]
                out.append([r.step(row if len(live) == 1 else dict(row)) for r in live])
            kept = [batch.column(n) for n in names]
            if several:
                found = pa.array([[dict(zip(fields, o, strict=True)) for o in own] for own in out], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([*kept, found], [*names, "outcomes"])
            else:
                columns = [pa.array([own[0][i] for own in out], kind.field(i).type) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, *fields])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*names).dtypes)
    added = "outcomes array<struct<" + OUTCOME.replace(" ", ":").replace(",:", ",") + ">>" if several else OUTCOME
    done = rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{schema}, {added}")
    if late is not None and waiting and not several:
        done = done.unionByName(late.withColumn("status", F.lit("PENDING")).withColumn("attempts", F.lit(0)), allowMissingColumns=True)
    return done


def with_versions(records: DataFrame, lookups: dict[str, DataFrame], *, key: str = "key", time: str = "event_time") -> DataFrame:
    """Adds for each lookup a struct column of its name: the version of the record's key that held at
    the record's time, null where there is none or it was deleted. ``lookups`` are changelogs of keyed
    tables; handlers read them as fields of the record. What is right through the frontier of all
    lookups is run by ``fold`` with ``gate='complete'`` and ``frontier_of`` them."""
    for name, versions in lookups.items():
        columns = [c for c in versions.columns if c not in (key, "kind")]
        found = as_of(records, versions, key=key, time=time, how="left", version_columns=columns)
        known = F.col(f"version_{columns[0]}").isNotNull()
        for c in columns[1:]:
            known = known | F.col(f"version_{c}").isNotNull()
        records = found.select(*records.columns, F.when(known, F.struct(*[F.col(f"version_{c}").alias(c) for c in columns])).alias(name))
    return records


def frontier_of(frontiers: list[float | None]) -> int | None:
    """The least of several frontiers (seconds) in microseconds, as gates take it; none if any is open."""
    if any(f is None or f == -math.inf for f in frontiers):
        return None
    return round(min(min(frontiers, default=math.inf), 1e11) * 1_000_000)


def discarded(records: DataFrame, outcomes: DataFrame, *, key: str = "key", event_id: str = "event_id") -> DataFrame:
    """Input to retain where it is discarded on success: records without a committed outcome."""
    done = outcomes.filter("status = 'COMMITTED'").select(F.col(key).alias("_k"), F.col(event_id).alias("_e"))
    return records.join(done, F.col(key).eqNullSafe(F.col("_k")) & F.col(event_id).eqNullSafe(F.col("_e")), "left_anti")


def latency_summary(outcomes: DataFrame, latency: Column, *, target: float, by: list[str] | None = None) -> DataFrame:
    """``n``, ``mean_latency``, ``max_latency`` and how many are ``overdue`` (over the target), of
    outcomes with a latency in seconds; of those that wait, their age."""
    return outcomes.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency"), F.count_if(latency > target).alias("overdue"))


def quarantine(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("status = 'FAILED'")


def latest_states(outcomes: DataFrame, version: int, *, key: str = "key", order: str = "sequence") -> DataFrame:
    return outcomes.groupBy(F.col(key).alias("key")).agg(F.max_by("state", order).alias("state")).withColumn("version", F.lit(version))


def batched(records: DataFrame, handler: Callable, schema: str, *, max_size: int = 1024) -> DataFrame:
    """A handler of lists of records, one result (a dict) each, on any rows; results follow ``schema``.

    A batch that fails is halved until the record that fails is alone; its result is null with ``error``.
    """
    if not 1 <= max_size <= 1024:
        raise ValueError("a batch has 1 to 1024 records")

    def attempt(rows):
        try:
            got = handler(rows)
            if len(got) != len(rows):
                raise ValueError("one result for each record is needed")
            return [(g, None) for g in got]
        except Exception as e:
            if len(rows) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(rows) // 2
            return attempt(rows[:half]) + attempt(rows[half:])

    columns = records.columns

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = frame.to_dict("records")
            results = [r for s in range(0, len(rows), max_size) for r in attempt(rows[s : s + max_size])]
            added = pd.DataFrame([(g or {}) | {"error": e} for g, e in results], index=frame.index)
            yield pd.concat([frame[columns], added.reindex(columns=[*fields, "error"])], axis=1)

    fields = [part.split()[0] for part in schema.split(",")]
    base = ", ".join(f"`{n}` {t}" for n, t in records.dtypes)
    return records.mapInPandas(run, f"{base}, {schema}, error string")


def compare(records: DataFrame, old: Process, new: Process, *, key: str = "key", event_id: str = "event_id", states: DataFrame | None = None) -> DataFrame:
    """Replay of two builds over the same records: whether their states and outputs agree, by event.
    Both are folded side by side in one task a key. ``states`` are initial states of both."""
    both = fold(records, [old, new], key=key, states=states)
    side = lambda i, name, f: F.col("outcomes")[i][f].alias(f"{name}_{f}")
    rows = both.select(F.col(key), F.col(event_id), *[side(i, n, f) for i, n in enumerate(("old", "new")) for f in ("state", "emitted")])
    return rows.withColumn("matches", F.col("old_state").eqNullSafe(F.col("new_state")) & F.col("old_emitted").eqNullSafe(F.col("new_emitted")))


def checksum(rows: DataFrame, columns: list[str]) -> dict:
    """How many rows there are, and a checksum of them that does not depend on their order: the sum of
    parts of their digests, which any other system can compute."""
    body = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    part = F.conv(F.substring(body, 1, 12), 16, 10).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(part)).first()
    return {"count": n, "checksum": format(int(total or 0) % 2**64, "016x")}


def manifest(records: DataFrame, columns: list[str], processes: list[Process] = (), *, states: DataFrame | None = None, histories: dict[str, DataFrame] | None = None) -> dict:
    """What a replay covers: the records, the builds, the initial states and the versioned histories
    that it reads, with checksums. Plain JSON values, with a digest of the whole."""
    low, high = records.agg(F.min("sequence"), F.max("sequence")).first()
    out = {"format": 1, "records": checksum(records, columns) | {"first_sequence": low, "last_sequence": high}}
    out["processes"] = [{"name": p.name, "version": p.version, "build": p.build} for p in processes]
    out["states"] = checksum(states, ["key", "state", "version"]) if states is not None else None
    out["histories"] = {n: checksum(h, h.columns) for n, h in sorted((histories or {}).items())}
    return out | {"digest": hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()}


def verify(found: dict, **given) -> None:
    """An error unless a manifest is whole and describes what is given (as ``manifest`` takes it)."""
    body = {k: v for k, v in found.items() if k != "digest"}
    if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != found.get("digest"):
        raise ValueError("the manifest was changed")
    now = manifest(**given)
    wrong = [k for k in now if now[k] != found.get(k) and k != "digest"]
    if wrong:
        raise ValueError(f"the replay does not match its manifest in {', '.join(wrong)}")
