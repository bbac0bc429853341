"""Structured Streaming forms of the operators whose timing Spark has no built-in for.

Filters run on streams as they are; windows and interval joins use Spark's own stateful operators. The
processors here hold state per key in the RocksDB state store (``configure`` sets it): de-duplication by earliest event time, temporal join
with completeness, keyed folds, and changelogs of windowed aggregates that survive retractions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import Interval
from ..operators.windows import WindowSpec
from .processors import AsOfJoin, FirstByTime, KeyedFold, RetractableMax

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def delay(seconds: float) -> str:
    return f"{round(seconds * 1000)} milliseconds"


def final_windows(records: DataFrame, spec: WindowSpec, aggregation: str, *, disorder: float, lateness: float = 0.0) -> DataFrame:
    """Each window of each key once, when the watermark passes its end and the lateness. Inputs: key,
    event_time and value; insert-only. ``key``, ``window_start``, ``window_end``, ``count`` and the value."""
    rows = records.select("key", F.col("event_time").cast("timestamp").alias("event_time"), F.col("value").cast("double").alias("value")).withWatermark("event_time", delay(disorder + lateness))
    size, step = round(spec.size * 1000), round(spec.step * 1000)
    window = F.window("event_time", f"{size} milliseconds", f"{step} milliseconds", f"{round(spec.origin * 1000) % step} milliseconds")
    value = {"count": [], "sum": [F.sum("value").alias("sum")], "max": [F.max("value").alias("max")]}[aggregation]
    out = rows.groupBy("key", window.alias("w")).agg(F.count("*").alias("count"), *value)
    # Spark also forms windows that begin before the origin.
    out = out.filter(F.unix_micros("w.start") >= round(spec.origin * 1_000_000))
    return out.select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", *[c for c in ("sum", "max") if c == aggregation])


def interval_join(left: DataFrame, right: DataFrame, bounds: Interval, *, disorder: float, lateness: float = 0.0) -> DataFrame:
    """Pairs as soon as both sides are there; the watermarks and the bounds let Spark drop old state.
    Inputs: key, event_time and body; ``key``, ``event_time`` (the later one), ``left`` and ``right``."""
    wait = delay(disorder + lateness)
    l = left.select(F.col("key"), F.col("event_time").cast("timestamp").alias("lt"), F.col("body").alias("left")).withWatermark("lt", wait)  # noqa: E741
    r = right.select(F.col("key").alias("rk"), F.col("event_time").cast("timestamp").alias("rt"), F.col("body").alias("right")).withWatermark("rt", wait)
    span = lambda s: F.expr(f"interval '{s:.6f}' second")
    on = (F.col("key") == F.col("rk")) & (F.col("rt") >= F.col("lt") + span(bounds.lower)) & (F.col("rt") <= F.col("lt") + span(bounds.upper))
    return l.join(r, on).select("key", F.greatest("lt", "rt").alias("event_time"), "left", "right")


def deduplicate(records: DataFrame, *, disorder: float, lateness: float = 0.0) -> DataFrame:
    """``key``, ``event_time``, ``sequence`` and ``body`` of the first record of each key by (event
    time, sequence), once the watermark has passed it. ``records``: key, event_time, sequence, body."""
    rows = records.select("key", F.col("event_time").cast("timestamp").alias("event_time"), "sequence", "body").withWatermark("event_time", delay(disorder + lateness))
    return rows.groupBy("key").transformWithState(FirstByTime(), "key string, event_time timestamp, sequence long, body string", "Append", "EventTime")


def as_of(probes: DataFrame, versions: DataFrame, *, disorder: float, lateness: float = 0.0, how: str = "inner") -> DataFrame:
    """Each probe, once it is complete, with the version that held: key, event_time, probe, version
    (JSON). Inputs: key, event_time, sequence, body, and kind for versions."""
    p = probes.select("key", F.col("event_time").cast("timestamp").alias("event_time"), "sequence", "body", F.lit(True).alias("is_probe"), F.lit("upsert").alias("kind"))
    v = versions.select("key", F.col("event_time").cast("timestamp").alias("event_time"), "sequence", "body", F.lit(False).alias("is_probe"), "kind")
    rows = p.unionByName(v).withWatermark("event_time", delay(disorder + lateness))
    return rows.groupBy("key").transformWithState(AsOfJoin(how), "key string, event_time timestamp, probe string, version string", "Append", "EventTime")


def fold(records: DataFrame, process) -> DataFrame:
    """A keyed process over a stream: key, sequence, state, emitted (JSON), error. Records of a
    micro-batch are folded in the order of ``sequence``; batches follow arrival."""
    rows = records.select("key", "sequence", "body")
    return rows.groupBy("key").transformWithState(KeyedFold(process), "key string, sequence long, state string, emitted string, error string", "Append", "None")


def maximum(records: DataFrame) -> DataFrame:
    """The changelog of a maximum per key over values with a diff: key, sequence, kind, value."""
    rows = records.select("key", "sequence", F.col("value").cast("double").alias("value"), F.col("diff").cast("long").alias("diff"))
    return rows.groupBy("key").transformWithState(RetractableMax(), "key string, sequence long, kind string, value double", "Append", "None")


def split_late(records: DataFrame, classify, accepted_path: str, late_path: str, checkpoint: str):
    """A query that classifies each micro-batch and writes both outputs: Spark drops late rows behind a
    watermark in silence, so they are split off before one. ``classify`` adds ``disposition``."""

    def both(batch: DataFrame, batch_id: int) -> None:
        judged = classify(batch).persist()
        judged.filter(F.col("disposition").startswith("accepted")).write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        judged.filter("disposition = 'side_output'").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        judged.unpersist()

    return records.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
