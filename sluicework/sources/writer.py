"""A stream as a folder that sources append to: with a cursor for each source, atomic batches and a seal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sinks import exists

MOST = 1000
RECORD = "partition int, event_time timestamp_ntz, key string, value string, kind string, event_id string, source_partition int, source_offset long"
STORED = f"{RECORD}, source_id string, sequence long, declared long, sealed boolean, checkpoint string, ingested timestamp_ntz"


class StreamWriter:
    """Appends records of one source to a stream's folder, one parquet folder a batch.

    A batch of 1 to 1000 records is written by one Spark job, so readers see all of it or nothing.
    Offsets of a source's partition go on from where the folder ends: records before that are there
    already and left out, a gap is an error. As a context, a ``bounded`` writer seals its partitions when
    it ends without an error. One writer at a time appends to a source.
    """

    def __init__(self, spark: SparkSession, folder: str, source_id: str, *, partitions: int = 1, bounded: bool = False):
        if not source_id.strip() or partitions < 1:
            raise ValueError("a writer has a source id and at least one partition")
        self.spark, self.folder, self.source_id, self.partitions, self.bounded = spark, folder.rstrip("/"), source_id, partitions, bounded

    def __enter__(self) -> StreamWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.bounded:
            self.seal()

    def stored(self) -> DataFrame:
        """All rows of the folder: records, declarations (``declared``) and seals (``sealed``)."""
        return self.spark.read.schema(STORED).parquet(f"{self.folder}/batch=*") if exists(self.spark, self.folder) else self.spark.createDataFrame([], STORED)

    def cursor(self) -> dict[int, int]:
        """The next offset of each of the source's partitions that has records."""
        mine = self.stored().filter((F.col("source_id") == self.source_id) & F.col("source_offset").isNotNull())
        return {r["source_partition"]: r["next"] for r in mine.groupBy("source_partition").agg((F.max("source_offset") + 1).alias("next")).collect()}

    def next_offset(self, source_partition: int = 0) -> int:
        return self.cursor().get(source_partition, 0)

    def checkpoint(self) -> str | None:
        """What the source gave to be kept with its last batch."""
        row = self.stored().filter((F.col("source_id") == self.source_id) & F.col("checkpoint").isNotNull()).agg(F.max_by("checkpoint", "sequence")).first()
        return row[0]

    def _append(self, rows: DataFrame) -> None:
        last, sealed = self.stored().agg(F.coalesce(F.max("sequence"), F.lit(-1)), F.collect_set(F.when(F.col("sealed"), F.col("partition")))).first()
        if rows.filter(F.col("partition").isin(*sealed) if sealed else F.lit(False)).limit(1).count():
            raise ValueError("a sealed partition takes no more records")
        placed = rows.withColumn("sequence", F.row_number().over(Window.orderBy("source_partition", "source_offset")) + F.lit(last)).withColumn("ingested", F.current_timestamp().cast("timestamp_ntz"))
        have = {f.name: f.dataType for f in self.spark.createDataFrame([], STORED).schema}
        full = placed.select(*[(F.col(n) if n in placed.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])
        full.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/batch={last + 1:012d}")

    def publish(self, records: DataFrame, checkpoint: str | None = None) -> int:
        """Append a batch (columns as ``RECORD``) and return how many of its records were new."""
        if checkpoint is not None and len(checkpoint.encode()) > 4096:
            raise ValueError("a checkpoint has at most 4096 bytes")
        if not 1 <= records.limit(MOST + 1).count() <= MOST:
            raise ValueError(f"a batch has 1 to {MOST} records")
        rows = records.select(*[c.split()[0] for c in RECORD.split(", ")]).collect()
        known = self.cursor()
        due, fresh = dict(known), []
        for r in sorted(rows, key=lambda r: (r["source_partition"], r["source_offset"])):
            p, offset = r["source_partition"], r["source_offset"]
            if not 0 <= r["partition"] < self.partitions or r["event_time"] is None:
                raise ValueError("a record needs an event time and a partition of the stream")
            if offset < known.get(p, 0):
                continue
            if offset != due.get(p, 0):
                raise ValueError(f"source partition {p} goes on at {due.get(p, 0)}, not at {offset}")
            due[p] = offset + 1
            fresh.append(r)
        if fresh:
            self._append(self.spark.createDataFrame(fresh, RECORD).withColumn("source_id", F.lit(self.source_id)).withColumn("checkpoint", F.lit(checkpoint)))
        return len(fresh)

    def advance_watermark(self, partition: int, seconds: float) -> None:
        """Declare that a partition is complete through a time; a lower one than before is an error."""
        mark = round(seconds * 1_000_000)
        held = self.stored().filter(F.col("partition") == partition).agg(F.max("declared")).first()[0]
        if held is not None and mark < held:
            raise ValueError("a declared watermark does not fall")
        self._append(self.spark.createDataFrame([(partition, mark, self.source_id, None, None)], "partition int, declared long, source_id string, source_partition int, source_offset long"))

    def seal(self) -> None:
        """End the partitions that are still open; sealing twice changes nothing."""
        ended = {r["partition"] for r in self.stored().filter("sealed").select("partition").distinct().collect()}
        rows = [(p, True, self.source_id, None, None) for p in range(self.partitions) if p not in ended]
        if rows:
            self._append(self.spark.createDataFrame(rows, "partition int, sealed boolean, source_id string, source_partition int, source_offset long"))

    def commits(self) -> DataFrame:
        """One row for each batch that went in: its records, sequences and checkpoint."""
        rows = self.spark.read.schema(f"{STORED}, batch long").option("basePath", self.folder).parquet(self.folder)
        return rows.groupBy("batch").agg(F.count("event_time").alias("records"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.max("checkpoint").alias("checkpoint"))

    def records(self) -> DataFrame:
        """The folder as a bounded stream, in the order of ``sequence`` by the reader."""
        return self.stored().filter("declared is null and not coalesce(sealed, false)")

    def stream(self, *, files_per_trigger: int = 16) -> DataFrame:
        """The same as an unbounded one; the trigger limit is the backpressure."""
        return self.spark.readStream.schema(STORED).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{self.folder}/batch=*")
