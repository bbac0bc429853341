"""Sinks: an outbox of messages with stable ids, each written once however often a batch is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def messages(emits: DataFrame, process: str, *, sequence: str = "sequence", payload: str = "emitted", origin: str = "process") -> DataFrame:
    """Non-null outputs with an id that a repeated run gives again; results of completed workflows are
    messages too, with ``origin='workflow'`` and the workflow's id as ``sequence``."""
    ident = F.concat_ws(":", F.lit(origin), F.lit(process), F.col(sequence).cast("string"))
    return emits.filter(F.col(payload).isNotNull()).select(ident.alias("message_id"), F.col(sequence).cast("string").alias("position"), F.col(payload).alias("payload"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class Outbox:
    """Messages, deliveries and acknowledgements under one folder, as tables that only grow.

    One writer appends. Delivery is at least once: a message is pending until it is acknowledged.
    """

    MESSAGES = "message_id string, position string, payload string"
    DELIVERIES = "message_id string, delivered_at timestamp"
    ACKS = "message_id string, acked_at timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def all(self) -> DataFrame:
        return self.table("messages", self.MESSAGES)

    def enqueue(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Append messages. One whose id is there with the same payload is left out; with another
        payload it is an error. A batch with an id has a folder of its own, so repeating it replaces it."""
        fresh = batch.groupBy("message_id").agg(F.min("position").alias("position"), F.min("payload").alias("payload"), F.max("payload").alias("_other"))
        old = self.all() if batch_id is None else self.table("messages", self.MESSAGES + ", batch int").filter(F.coalesce(F.col("batch") != batch_id, F.lit(True)))
        old = old.select("message_id", F.col("payload").alias("_there"))
        fresh = fresh.join(old, "message_id", "left")
        same = (F.col("payload") == F.col("_other")) & F.coalesce(F.col("payload") == F.col("_there"), F.lit(True))
        if fresh.filter(~same).limit(1).count():
            raise ValueError("a message id came again with another payload")
        fresh = fresh.filter(F.col("_there").isNull()).select("message_id", "position", "payload")
        path = f"{self.folder}/messages/batch={-1 if batch_id is None else batch_id}"
        fresh.write.mode("append" if batch_id is None else "overwrite").parquet(path)

    def pending(self) -> DataFrame:
        """Messages without an acknowledgement, with how often they were delivered."""
        tried = self.table("deliveries", self.DELIVERIES).groupBy("message_id").agg(F.count("*").alias("attempts"))
        rows = self.all().join(self.table("acks", self.ACKS).select("message_id").distinct(), "message_id", "left_anti")
        return rows.join(tried, "message_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))

    def poll(self, most: int = 1) -> list:
        """The oldest pending messages, as rows, at most ``most``; the delivery counts as an attempt."""
        first = Window.orderBy(F.length("position"), "position", "message_id")
        rows = self.pending().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n").collect()
        if rows:
            sent = self.spark.createDataFrame([(r["message_id"],) for r in rows], "message_id string")
            sent.withColumn("delivered_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/deliveries")
        return rows

    def ack(self, message_ids: list[str]) -> None:
        """Acknowledge messages; a repeated acknowledgement changes nothing, an unknown id is an error."""
        named = self.spark.createDataFrame([(m,) for m in message_ids], "message_id string")
        if named.join(self.all(), "message_id", "left_anti").limit(1).count():
            raise ValueError("an acknowledgement of an unknown message")
        fresh = named.distinct().join(self.table("acks", self.ACKS), "message_id", "left_anti")
        fresh.select("message_id", F.current_timestamp().alias("acked_at")).coalesce(1).write.mode("append").parquet(f"{self.folder}/acks")

    def write_stream(self, stream: DataFrame, checkpoint: str):
        """A streaming query into the outbox; ends when the input that is there has been read."""
        return stream.writeStream.foreachBatch(lambda df, batch_id: self.enqueue(df, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
