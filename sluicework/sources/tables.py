"""Tables as streams of enveloped records, bounded or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream; the trigger limit is the backpressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan(records: DataFrame, *, after: int | None = None) -> DataFrame:
    """Retained records in admission order, from a sequence on; the condition reaches the scan."""
    rows = records if after is None else records.filter(F.col("sequence") > after)
    return rows.orderBy("sequence")


def envelope(rows: DataFrame, *, stream: str, key: str | None, time: str, sequence: str, value: list[str], kind: str | None = None, partition: str | None = None, event_id: str | None = None) -> DataFrame:
    """Rows as records: key as text, value as a struct that column pruning sees through."""
    pick = lambda name, default: F.col(name) if name else F.lit(default)
    return rows.select(
        F.lit(stream).alias("stream"), pick(partition, 0).cast("int").alias("partition"), F.col(sequence).cast("long").alias("sequence"), F.col(time).alias("event_time"),
        pick(key, None).cast("string").alias("key"), F.struct(*value).alias("value"), pick(kind, "upsert").alias("kind"), pick(event_id, None).cast("string").alias("event_id"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table keyed by user; admission order is the event id."""
    rows = table(spark, folder, "events")
    return envelope(rows, stream="events", key="user_id", time="ts", sequence="event_id", event_id="event_id", value=["event_id", "user_id", "event_type", "value", "props"])
