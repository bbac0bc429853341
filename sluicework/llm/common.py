"""What the operators share: staged tables in the cluster's shared folder, and null handling."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process, as in local tests, a temporary folder is
    made and set; on a cluster that is an error, as executors do not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sluicework-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Staging:
    """Tables written to the shared folder to cut lineage; a lost executor re-reads them.

    ``live`` has all that were made and hold tables, so that whoever has written a result can remove
    what went into it.
    """

    live: list[Staging] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        if self not in Staging.live:
            Staging.live.append(self)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no pending plan reads any more."""
        jvm, path = self.spark.sparkContext._jvm, f"{self.root}/{name}"
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.names.discard(name)

    def clear(self, *kept: str) -> None:
        """Remove all tables but these, once no other is read any more."""
        for name in sorted(self.names - set(kept)):
            self.drop(name)
        if not self.names and self in Staging.live:
            Staging.live.remove(self)


def release() -> None:
    """Give memory that fitting has freed back to the system; the driver's share of it is small."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns renamed, so that no name of its own meets one of an operator's, and
    the new name of each old one. ``restored`` undoes it."""
    names = {c: f"column_{i}_of_input" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])
