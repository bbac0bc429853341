"""Materialised views and named snapshots of several of them on one input cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .changelog import fold
from .ranking import limited

LIMIT, MOST = 10_000, 32


def materialize(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Key and row with their count, time left out of the identity."""
    return fold(changes, columns)


def rows_of(view: DataFrame, *, where: dict | None = None, limit: int = LIMIT) -> DataFrame:
    """The current rows of a collection or view, all or those of one key or group; more than ``limit``
    are an error rather than a part of them. The condition is a plain one and reaches the scan."""
    for name, value in (where or {}).items():
        view = view.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return limited(view, limit)


def snapshot(spark: SparkSession, views: dict[str, DataFrame], folder: str, name: str, *, inputs: dict[str, tuple[str, str]] | None = None, positions: DataFrame | None = None, limit: int = LIMIT) -> str:
    """Write each view under ``folder/name`` and return the kind of the cut; an existing snapshot is an
    error, as snapshots never change, and so is a view of more than ``limit`` rows.

    Several views are only taken together where they show one cut of their input: all are filters of
    one stream. ``inputs`` has (kind, stream) of each view; the cut is then ``shared_input_cut``, else
    ``operator_output_cut``. ``positions`` (partition, sequence) records the cut of the input.
    """
    if not 1 <= len(views) <= MOST:
        raise ValueError(f"a snapshot has 1 to {MOST} views")
    of = [(inputs or {}).get(title) for title in views]
    if len(views) > 1 and (None in of or len({stream for _, stream in of}) > 1 or any(kind != "filter" for kind, _ in of)):
        raise ValueError("several views need to be filters of one stream")
    cut = "shared_input_cut" if of[0] is not None and of[0][0] == "filter" else "operator_output_cut"
    spark.createDataFrame([(name, cut)], "name string, cut string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/{name}/_cut")
    for title, view in views.items():
        path = f"{folder}/{name}/{title}"
        view.limit(limit + 1).write.mode("errorifexists").parquet(path)
        if spark.read.parquet(path).count() > limit:
            delete(spark, folder, name)
            raise ValueError(f"a view has more than {limit} rows")
    if positions is not None:
        positions.groupBy("partition").agg(F.max("sequence").alias("through")).write.mode("errorifexists").parquet(f"{folder}/{name}/_positions")
    return cut


def read(spark: SparkSession, folder: str, name: str, view: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/{view}")


def delete(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
