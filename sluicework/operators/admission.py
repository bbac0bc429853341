"""Admission: idempotence, source offsets, watermarks, lateness and where late records go.

Watermarks are running maxima over the admission order. A plain running window over all records would
put them into one task; here records are cut into ranges of ``sequence``, each range is summed up in
one row for all partitions of the stream, and ranges get what came before them from a running window
over those rows alone. It is one exchange and one sort however many partitions the stream has, and no
job runs while the plan is built.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import StreamPolicy, micros, require, seconds


def idempotent(records: DataFrame, *, event_id: str = "event_id", sequence: str = "sequence", content: tuple[str, ...] = ("partition", "event_time", "key", "value", "kind"), scope: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """The first record of each event id; records without one all stay. A later record with the same
    id and other content is an error where ``strict``. With ``scope`` (the key, for records that go to a
    process directly) an id counts within these columns. One aggregation by id."""
    content = tuple(c for c in content if c in records.columns)
    by = [*scope, event_id]
    named = records.filter(F.col(event_id).isNotNull())
    same = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    found = named.groupBy(*by).agg(F.min_by(F.struct(*[c for c in records.columns if c not in by]), sequence).alias("_r"), F.min(same).alias("_low"), F.max(same).alias("_high"))
    if strict:
        found = require(found, F.col("_low") == F.col("_high"), "an event id came again with other content")
    return found.select(*by, "_r.*").select(*records.columns).unionByName(records.filter(F.col(event_id).isNull()))


def derived_event_id(records: DataFrame) -> DataFrame:
    """``event_id`` from the source position where none is given."""
    source = F.when(F.col("source_id").isNotNull(), F.concat_ws(":", F.lit("source"), "source_id", F.col("source_partition").cast("string"), F.col("source_offset").cast("string")))
    return records.withColumn("event_id", F.coalesce("event_id", source))


def offset_gaps(records: DataFrame) -> DataFrame:
    """Source positions that do not follow the one before: source, partition, expected, found."""
    w = Window.partitionBy("source_id", "source_partition").orderBy("source_offset")
    rows = records.filter("source_id is not null").select("source_id", "source_partition", "source_offset").distinct()
    rows = rows.withColumn("expected", F.coalesce(F.lag("source_offset").over(w) + 1, F.lit(0).cast("long")))
    return rows.filter("source_offset != expected").select("source_id", "source_partition", "expected", F.col("source_offset").alias("found"))


def ranged(records: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Adds ``_range``: equal parts of the admission order, which is close to dense. The ends come from
    a subquery that runs with the plan."""
    parts = ranges or 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = records.select(F.struct(F.min(order).alias("low"), F.max(order).alias("high")).alias("ends")).scalar()
    rows = records.withColumn("_ends", ends)
    place = F.floor((F.col(order) - F.col("_ends.low")) / (F.col("_ends.high") - F.col("_ends.low") + 1) * parts).cast("int")
    return rows.withColumn("_range", place).drop("_ends")


def running(rows: DataFrame, values: dict[str, Column], order: str) -> DataFrame:
    """Adds the running maximum of each value before the row, over all rows; ``rows`` have ``_range``."""
    tops = rows.groupBy("_range").agg(*[F.max(v).alias(n) for n, v in values.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges, a fixed number: small enough for one window and to send to every task.
    before = tops.select("_range", *[F.max(n).over(earlier).alias(f"_before_{n}") for n in values])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.max(v).over(inside).alias(n) for n, v in values.items()])
    out = own.join(F.broadcast(before), "_range")
    return out.select(*rows.columns, *[F.greatest(n, f"_before_{n}").alias(n) for n in values])


def least_of(active: list[tuple[Column, Column]]) -> Column:
    """The least watermark of the (active, watermark) pairs that are active, if all of those have one."""
    marks = [F.when(on, mark) for on, mark in active]
    ready = reduce(lambda a, b: a & b, [~on | mark.isNotNull() for on, mark in active])
    return F.when(ready, F.least(*marks) if len(marks) > 1 else marks[0])


def watermarks(records: DataFrame, policy: StreamPolicy, *, time: str = "event_time", order: str = "sequence", declared: str | None = None, sealed: str | None = None, ingested: str | None = None, created: float | None = None) -> DataFrame:
    """Adds ``watermark_before``: the combined watermark (microseconds) before each record.

    A partition's watermark is its greatest event time less the disorder, or what it has declared; the
    combined one is the least over all active partitions, once every one of them has a watermark, and
    never falls. ``declared`` names a column with declared watermarks (microseconds) of source-managed
    streams; records without one declare nothing.

    ``sealed`` names a boolean column: a row where it is true ends its partition, which takes no further
    part, and moves no watermark itself. ``ingested`` names the time at which a row came in: a partition
    without a row for the policy's ``idle_timeout`` (since ``created``, in seconds, if it never had one)
    is idle at a row's time and takes no part until its next row.
    """
    own = F.col(declared) if policy.watermark == "source_managed" else micros(time) - F.lit(seconds(policy.bound))
    ends = F.coalesce(F.col(sealed), F.lit(False)) if sealed else F.lit(False)
    parts = range(policy.partitions)
    mine = {p: F.col("partition") == p if policy.partitions > 1 else F.lit(True) for p in parts}
    rows = ranged(records, order)
    values = {f"_wm{p}": F.when(mine[p] & ~ends, own) for p in parts}
    if sealed:
        values |= {f"_end{p}": F.when(mine[p] & ends, 1) for p in parts}
    if ingested:
        values |= {f"_seen{p}": F.when(mine[p], micros(ingested)) for p in parts}
    rows = running(rows, values, order)
    now = micros(ingested) if ingested else None
    active = {}
    for p in parts:
        on = F.lit(True)
        if sealed:
            on = on & F.col(f"_end{p}").isNull()
        if ingested:
            last = F.coalesce(F.col(f"_seen{p}"), F.lit(None if created is None else seconds(created)))
            on = on & F.coalesce(now - last < seconds(policy.idle_timeout), F.lit(True))
        active[p] = on
    mark = least_of([(active[p], F.col(f"_wm{p}")) for p in parts])
    if not sealed and not ingested:
        # No partition ever leaves, so neither its watermark nor the least of them falls.
        return rows.withColumn("watermark_before", mark).select(*records.columns, "watermark_before")
    # What the record itself makes of it: its partition is active again, with its own watermark.
    after = least_of([(F.when(mine[p], ~ends).otherwise(active[p]), F.when(mine[p] & ~ends, F.greatest(f"_wm{p}", own)).otherwise(F.col(f"_wm{p}"))) for p in parts])
    rows = rows.select(*records.columns, "_range", mark.alias("_now"), after.alias("_after"))
    rows = running(rows, {"_then": F.greatest("_now", "_after")}, order)
    return rows.withColumn("watermark_before", F.greatest("_then", "_now")).select(*records.columns, "watermark_before")


def classify(records: DataFrame, policy: StreamPolicy, *, time: str = "event_time", order: str = "sequence", **progress) -> DataFrame:
    """Adds ``watermark_before``, ``late``, ``too_late`` and ``disposition``.

    Lateness is judged against the watermark before the record moves it, and bounds are inclusive.
    ``progress`` goes to ``watermarks``.
    """
    rows = watermarks(records, policy, time=time, order=order, **progress)
    at, mark = micros(time), F.col("watermark_before")
    rows = rows.withColumn("late", F.coalesce(at <= mark, F.lit(False))).withColumn("too_late", F.coalesce(at <= mark - F.lit(seconds(policy.lateness)), F.lit(False)))
    refused = {"drop": "dropped", "side_output": "side_output", "accept": "accepted_too_late"}[policy.late_policy]
    return rows.withColumn("disposition", F.when(F.col("too_late"), refused).when(F.col("late"), "accepted_late").otherwise("accepted"))


def accepted(classified: DataFrame) -> DataFrame:
    """Records that operators see, late ones that are not too late included."""
    return classified.filter(F.col("disposition").isin("accepted", "accepted_late", "accepted_too_late"))


def side_output(classified: DataFrame) -> DataFrame:
    return classified.filter("disposition = 'side_output'")


class Alignment:
    """The watermarks of a stream's partitions, moved by the records that alignment lets in."""

    def __init__(self, marks: list[int | None], drift: int):
        self.marks, self.drift = list(marks), drift

    def limit(self, partition: int) -> float:
        """How far a partition may go: unlimited until every other one has a watermark."""
        others = [m for q, m in enumerate(self.marks) if q != partition]
        return min(others) + self.drift if others and None not in others else math.inf

    def admit(self, partition: int, own: int) -> bool:
        mark = self.marks[partition]
        moved = own if mark is None else max(own, mark)
        if moved > self.limit(partition):
            return False
        self.marks[partition] = moved
        return True

    def lets_in(self, tops: dict[int, int]) -> bool:
        """Whether records up to these watermarks are let in whatever their order: limits only rise
        once all partitions have a watermark."""
        return len(self.marks) == 1 or None not in self.marks and all(own <= self.limit(p) for p, own in tops.items())


def misaligned(records: DataFrame, policy: StreamPolicy, *, time: str = "event_time", order: str = "sequence", ranges: int | None = None, most: int = 1_000_000) -> DataFrame:
    """Adds ``rejected_alignment``: the record would push its partition's watermark further than the
    drift above the least of the others. A rejected record moves nothing.

    Whether a record is let in depends on all that were before, so the stream is folded in order: the
    driver holds one watermark for each partition. Ranges in which nothing can be rejected, by their
    greatest event times, are passed over; only runs of others, of ``most`` rows or a single range, are
    folded record by record, one task after the other. In the end all ranges are judged side by side
    from the state in which each begins.
    """
    if policy.drift is None:
        return records.withColumn("rejected_alignment", F.lit(False))
    own = micros(time) - F.lit(seconds(policy.bound))
    rows = ranged(records, order, ranges).withColumn("_own", own)
    tops: dict[int, dict[int, int]] = {}
    sizes: dict[int, int] = {}
    for r in rows.groupBy("_range", "partition").agg(F.max("_own").alias("top"), F.count("*").alias("n")).collect():  # ranges x partitions
        tops.setdefault(r["_range"], {})[r["partition"]] = r["top"]
        sizes[r["_range"]] = sizes.get(r["_range"], 0) + r["n"]
    now = Alignment([None] * policy.partitions, seconds(policy.drift))
    begin: dict[int, list[int | None]] = {}

    def fold(marks: list[int | None]):
        def run(batches):
            state, seen = Alignment(marks, seconds(policy.drift)), {}
            for batch in batches:
                for r, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if r not in seen:
                        seen[r] = list(state.marks)
                    state.admit(p, t)
            seen[-1] = state.marks
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.list_(pa.int64()))], ["r", "marks"])

        return run

    waiting = sorted(tops)
    while waiting:
        if now.lets_in(tops[waiting[0]]):
            for p, top in tops[waiting.pop(0)].items():
                now.admit(p, top)
            continue
        take = next((n for n in range(1, len(waiting)) if sum(sizes[r] for r in waiting[: n + 1]) > most), len(waiting))
        hard, waiting = waiting[:take], waiting[take:]
        part = rows.filter(F.col("_range").between(hard[0], hard[-1])).repartition(1).sortWithinPartitions(order).select("_range", "partition", "_own")
        found = {r["r"]: r["marks"] for r in part.mapInArrow(fold(now.marks), "r int, marks array<long>").collect()}
        now.marks = found.pop(-1)
        begin |= found
    if not begin:
        return records.withColumn("rejected_alignment", F.lit(False))

    def judge(batches):
        at, state = None, None
        for batch in batches:
            found = []
            for r, p, t in zip(*(batch.column(n).to_pylist() for n in ("_range", "partition", "_own")), strict=True):
                if r != at:
                    at, state = r, Alignment(begin[r], seconds(policy.drift))
                found.append(not state.admit(p, t))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], [*names, "rejected_alignment"])

    names = records.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in records.dtypes) + ", rejected_alignment boolean"
    hard = F.col("_range").isin(*begin)
    judged = rows.filter(hard).repartition("_range").sortWithinPartitions("_range", order).mapInArrow(judge, schema)
    return judged.unionByName(rows.filter(~hard).select(*names, F.lit(False).alias("rejected_alignment")))


def whole_batches(records: DataFrame, batch: str, valid: Column, *, most: int = 1000) -> DataFrame:
    """Adds ``admitted``: a batch of 1 to ``most`` records goes in whole, if each of them is valid, or
    not at all. One aggregation by batch, joined on its unique name."""
    judged = records.groupBy(F.col(batch).alias("_batch")).agg(((F.count("*") <= most) & F.min(F.coalesce(valid, F.lit(False)))).alias("admitted"))
    return records.join(judged, F.col(batch).eqNullSafe(F.col("_batch"))).select(*records.columns, "admitted")


def frontier(watermark: float | None, lateness: float, *, sealed: bool = False) -> float:
    """Completeness: no accepted record at or before it is to come. Infinite once sealed."""
    if sealed:
        return math.inf
    return -math.inf if watermark is None else watermark - lateness


def combined(partitions: list[dict]) -> float | None:
    """The least watermark of the partitions that are neither sealed nor idle, if all have one."""
    live = [p for p in partitions if not p.get("sealed") and not p.get("idle")]
    marks = [p.get("watermark") for p in live]
    return min(marks) if marks and all(m is not None for m in marks) else None


def finality(partitions: list[dict], policy: StreamPolicy, before: float | None = None) -> dict:
    """How complete a stream is and why: pending, lateness_cutoff, source_declaration, sealed_input."""
    if partitions and all(p.get("sealed") for p in partitions):
        return {"basis": "sealed_input", "complete_through": math.inf, "idle": [], "accepts_changes": False}
    idle = [i for i, p in enumerate(partitions) if p.get("idle") and not p.get("sealed")]
    marks = [m for m in (combined(partitions), before) if m is not None]
    if not marks:
        return {"basis": "pending", "complete_through": None, "idle": idle, "accepts_changes": True}
    declared = not idle and all(p.get("declared") is not None and p["declared"] >= p["watermark"] for p in partitions if not p.get("sealed"))
    basis = "source_declaration" if declared or policy.watermark == "source_managed" and not idle else "lateness_cutoff"
    return {"basis": basis, "complete_through": max(marks) - policy.lateness, "idle": idle, "accepts_changes": policy.late_policy == "accept"}


def monotone(records: DataFrame, declared: str, order: str = "sequence") -> DataFrame:
    """Declared watermarks must not fall within a partition."""
    w = Window.partitionBy("partition").orderBy(order)
    rows = records.withColumn("_prev", F.lag(declared).over(w))
    return require(rows, F.coalesce(F.col(declared) >= F.col("_prev"), F.lit(True)), "a declared watermark fell").drop("_prev")


def diagnose(partitions: list[dict], policy: StreamPolicy) -> dict:
    """Which partitions hold the combined watermark back, and why it does not move."""
    live = {i: p for i, p in enumerate(partitions) if not p.get("sealed") and not p.get("idle")}
    silent = [i for i, p in live.items() if p.get("watermark") is None]
    if not live:
        reason = "sealed" if partitions and all(p.get("sealed") for p in partitions) else "all partitions idle"
        return {"blocking": [], "reason": reason}
    if silent:
        return {"blocking": silent, "reason": "no declared watermark" if policy.watermark == "source_managed" else "no records yet"}
    least = min(p["watermark"] for p in live.values())
    return {"blocking": [i for i, p in live.items() if p["watermark"] == least], "reason": "least watermark"}


def operator_frontier(kind: str, inputs: list[float | None], *, pending: bool = False) -> float | None:
    """Through which time an operator's output is complete: the least of its inputs, none while a
    process has work to do. A normalised table or a ranking may take rows back at any time, so its
    output is complete only when its input is sealed."""
    if pending or any(f is None or f == -math.inf for f in inputs):
        return None
    least = min(inputs, default=math.inf)
    return None if kind in ("normalize", "top_n") and least != math.inf else least


def timer_due(at: float, watermark: float | None, *, sealed: bool = False) -> bool:
    """An event-time timer fires by the raw watermark (not the frontier), or once input is sealed."""
    return sealed or watermark is not None and watermark >= at


def timers_due(timers: DataFrame, watermark: float | None, *, at: str = "at", sealed: bool = False) -> DataFrame:
    """The event-time timers (and waits) that fire, as ``timer_due`` says of one."""
    if sealed:
        return timers
    return timers.filter(F.lit(False) if watermark is None else micros(at) <= seconds(watermark))


def declare_complete(partitions: list[dict], through: float, policy: StreamPolicy) -> list[dict]:
    """Partitions after a declaration that the stream is complete through a time: the watermark of
    those that are not sealed becomes the time plus the lateness; a lower one is an error."""
    mark = through + policy.lateness
    out = []
    for p in partitions:
        if not p.get("sealed"):
            if p.get("watermark") is not None and p["watermark"] > mark:
                raise ValueError("a watermark does not fall")
            p = p | {"watermark": mark, "declared": mark, "idle": False}
        out.append(p)
    return out
