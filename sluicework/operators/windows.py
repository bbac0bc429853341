"""Tumbling and sliding event-time windows over records with row kinds."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import micros, require, seconds, weight


@dataclass(frozen=True)
class WindowSpec:
    """Windows [start, start + size) with start = origin + k * slide, k >= 0. Seconds."""

    size: float
    slide: float | None = None
    origin: float = 0.0

    def __post_init__(self):
        if not self.size > 0 or not 0 < self.step <= self.size:
            raise ValueError("a window has 0 < slide <= size")

    @property
    def step(self) -> float:
        return self.slide if self.slide is not None else self.size


def assign(records: DataFrame, spec: WindowSpec, *, time: str = "event_time") -> DataFrame:
    """A row for each window of each record, with ``window_start`` and ``window_end``.

    Records before the origin and windows that would begin before it are left out. Starts are computed
    arithmetically, so one exchange by window and key is all that an aggregation needs.
    """
    size, step, origin = seconds(spec.size), seconds(spec.step), seconds(spec.origin)
    since = micros(time) - F.lit(origin)
    last = F.floor(since / F.lit(step)).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((since - F.lit(size)) / F.lit(step)).cast("long") + 1)
    rows = records.filter(since >= 0)
    starts = F.array(last) if size == step else F.sequence(first, last)
    rows = rows.withColumn("_k", F.explode(starts)) if size != step else rows.withColumn("_k", last)
    to_time = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
    begin = F.lit(origin) + F.col("_k") * F.lit(step)
    return rows.withColumn("window_start", to_time(begin)).withColumn("window_end", to_time(begin + F.lit(size))).drop("_k")


def aggregate(records: DataFrame, spec: WindowSpec, aggregation: str, value: Column | None = None, *, key: str = "key", time: str = "event_time", retracting: bool = True, strict: bool = True) -> DataFrame:
    """``key``, window bounds, ``count`` and, for sum and max, the value.

    Without retractions the maximum is a plain one; with them, values are netted first, so that
    retracting the maximum brings back the one before. Groups that net to nothing disappear.
    """
    if aggregation not in ("count", "sum", "max"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    if aggregation != "count" and value is None:
        raise ValueError(f"{aggregation} needs a value")
    rows = assign(records.withColumn("_diff", weight() if retracting else F.lit(1)), spec, time=time)
    rows = rows.select(F.col(key).alias("key"), "window_start", "window_end", "_diff", *([value.cast("double").alias("_v")] if value is not None else []))
    by = ["key", "window_start", "window_end"]
    count = F.sum("_diff").cast("long").alias("count")
    if aggregation == "count":
        out = rows.groupBy(*by).agg(count)
    elif aggregation == "sum":
        out = rows.groupBy(*by).agg(count, F.sum(F.col("_v") * F.col("_diff")).alias("sum"))
    elif not retracting:
        out = rows.groupBy(*by).agg(count, F.max("_v").alias("max"))
    else:
        each = rows.groupBy(*by, "_v").agg(F.sum("_diff").alias("n"))
        out = each.groupBy(*by).agg(F.sum("n").cast("long").alias("count"), F.max(F.when(F.col("n") > 0, F.col("_v"))).alias("max"))
    if retracting:
        if strict:
            out = require(out, F.col("count") >= 0, "a window was retracted more often than it was added to")
        out = out.filter("count > 0")
    return out


def with_empty(windows: DataFrame, spec: WindowSpec, *, columns: tuple[str, ...] = ("sum", "max")) -> DataFrame:
    """Adds a row with a null key and count 0 for each window between origin and the last one that
    holds no key at all. The spine has a row for each window, not for each record."""
    size, step, origin = seconds(spec.size), seconds(spec.step), seconds(spec.origin)
    last = windows.agg(F.max(micros("window_start")).alias("last"))
    spine = last.select(F.explode(F.sequence(F.lit(origin), F.col("last"), F.lit(step))).alias("us")).filter("us is not null")
    spine = spine.select(F.timestamp_micros("us").cast("timestamp_ntz").alias("window_start"), F.timestamp_micros(F.col("us") + size).cast("timestamp_ntz").alias("window_end"))
    missing = spine.join(windows.select("window_start").distinct(), "window_start", "left_anti")
    blank = [F.lit(None).cast(dict(windows.dtypes)["key"]).alias("key"), "window_start", "window_end", F.lit(0).cast("long").alias("count")]
    blank += [F.lit(None if c == "max" else 0.0).cast("double").alias(c) for c in columns if c in windows.columns]
    return windows.unionByName(missing.select(*blank))


def due(windows: DataFrame, watermark: float, lateness: float = 0.0) -> DataFrame:
    """Windows that have fired at a watermark (seconds): it has reached their end and the lateness."""
    return windows.filter(micros("window_end") + F.lit(seconds(lateness)) <= F.lit(seconds(watermark)))


def changes(records: DataFrame, spec: WindowSpec, value: Column | None = None, *, key: str = "key", time: str = "event_time", order: str = "sequence") -> DataFrame:
    """The changelog of a windowed count and sum: a row that came first inserts, later ones update,
    the last retraction deletes. Times are those of the records."""
    rows = assign(records.withColumn("_diff", weight()), spec, time=time)
    rows = rows.withColumn("_v", (value if value is not None else F.lit(0.0)).cast("double"))
    by = Window.partitionBy(key, "window_start").orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum("_diff").over(upto).cast("long")).withColumn("_s", F.sum(F.col("_v") * F.col("_diff")).over(upto))
    rows = require(rows, F.col("_n") >= 0, "a window was retracted more often than it was added to")
    rows = rows.withColumn("_pn", F.coalesce(F.lag("_n").over(by), F.lit(0).cast("long"))).withColumn("_ps", F.coalesce(F.lag("_s").over(by), F.lit(0.0)))
    row = lambda n, s, kind, diff: F.struct(n.alias("count"), s.alias("sum"), F.lit(kind).alias("kind"), F.lit(diff).cast("long").alias("diff"))
    old, new = (F.col("_pn"), F.col("_ps")), (F.col("_n"), F.col("_s"))
    out = (
        F.when((F.col("_pn") == 0) & (F.col("_n") > 0), F.array(row(*new, "insert", 1)))
        .when((F.col("_pn") > 0) & (F.col("_n") == 0), F.array(row(*old, "delete", -1)))
        .when(F.col("_pn") > 0, F.array(row(*old, "update_before", -1), row(*new, "update_after", 1)))
    )
    return rows.select(F.col(key).alias("key"), "window_start", "window_end", F.col(time).alias("event_time"), F.col(order).alias("sequence"), F.explode(out).alias("c")).select("key", "window_start", "window_end", "event_time", "sequence", "c.*")


def max_changes(records: DataFrame, spec: WindowSpec, value: Column, *, key: str = "key", time: str = "event_time", order: str = "sequence") -> DataFrame:
    """The changelog of a windowed maximum: every record of a window replaces its row, as ``changes``
    does, with ``count`` and ``max``.

    Taking back the largest value brings back the one before, so the values that a window holds are kept
    while its rows stream by in order: a task holds the distinct values of one key's window.
    """
    rows = assign(records.withColumn("_diff", weight()), spec, time=time)
    rows = rows.select(F.col(key).alias("key"), "window_start", "window_end", F.col(time).alias("event_time"), F.col(order).alias("sequence"), value.cast("double").alias("_v"), "_diff")
    names = ["key", "window_start", "window_end", "event_time", "sequence"]

    def run(batches):
        at, held, heap, count, top = None, {}, [], 0, None
        for batch in batches:
            take, counts, tops, kinds, diffs = [], [], [], [], []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), strict=True)
            for i, (group, v, d) in enumerate(zip(keys, batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                if group != at:
                    at, held, heap, count, top = group, {}, [], 0, None
                before = (count, top)
                count += d
                held[v] = held.get(v, 0) + d
                if held[v] < 0 or count < 0:
                    raise ValueError("a window was retracted more often than it was added to")
                if d > 0 and held[v] == 1:
                    heapq.heappush(heap, -v)
                while heap and not held.get(-heap[0]):
                    held.pop(-heapq.heappop(heap), None)
                top = -heap[0] if heap else None
                rows = [(*before, "update_before" if count else "delete", -1)] if before[0] else []
                rows += [(count, top, "update_after" if before[0] else "insert", 1)] if count else []
                for n, t, kind, diff in rows:
                    take.append(i)
                    counts.append(n)
                    tops.append(t)
                    kinds.append(kind)
                    diffs.append(diff)
            which = pa.array(take, pa.int32())
            made = [pa.array(counts, pa.int64()), pa.array(tops, pa.float64()), pa.array(kinds, pa.string()), pa.array(diffs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(which) for n in range(5)), *made], [*names, "count", "max", "kind", "diff"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*names).dtypes) + ", count long, max double, kind string, diff long"
    return rows.repartition("key", "window_start").sortWithinPartitions("key", "window_start", "sequence").mapInArrow(run, schema)


def fired(windows: DataFrame, schedule: str, stream: str, aggregation: str, watermark: float, *, finalized: bool = False, lateness: float = 0.0) -> DataFrame:
    """Windows that have fired, as messages: with the watermark, whether the input was sealed, and an id
    that a repeated run gives again. A sealed input fires all windows."""
    rows = windows if finalized else due(windows, watermark, lateness)
    ident = F.concat_ws(":", F.lit("window"), F.lit(schedule), F.coalesce("key", F.lit("")), micros("window_start").cast("string"))
    return rows.select(F.lit(schedule).alias("schedule"), F.lit(stream).alias("stream"), F.lit(aggregation).alias("aggregation"), *rows.columns, F.lit(watermark).alias("watermark"), F.lit(finalized).alias("finalized"), ident.alias("id"))
