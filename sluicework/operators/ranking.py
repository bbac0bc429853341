"""Retractable top-N per group, and keep-first de-duplication by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import require

EXACT = 1 << 53


def ordering(order_by: list[tuple[str, str]], ties: list[str]) -> list[Column]:
    """Nulls last in either direction; ``ties`` end in a total order."""
    if not order_by:
        raise ValueError("top-N needs an order")
    out = []
    for name, direction in order_by:
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown direction {direction!r}")
        out.append(F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_last())
    return [*out, *[F.col(t).asc_nulls_last() for t in ties]]


def sortable(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose sort fields have an order that is the same everywhere; others are errors."""
    kinds = dict(rows.dtypes)
    for name in fields:
        kind, col = kinds[name], F.col(name)
        if kind in ("double", "float"):
            rows = require(rows, col.isNull() | (~F.isnan(col) & (F.abs(col) != float("inf"))), f"sort field {name} is not finite")
            rows = rows.withColumn(name, F.when(col == 0, F.lit(0.0)).otherwise(col).cast(kind))
        elif kind in ("bigint", "int", "smallint", "tinyint"):
            rows = require(rows, col.isNull() | col.between(-EXACT, EXACT), f"sort field {name} is beyond exact numbers")
        elif kind not in ("string", "boolean", "date", "timestamp", "timestamp_ntz") and not kind.startswith("decimal"):
            raise ValueError(f"sort field {name} has no scalar type: {kind}")
    return rows


def pinned(rows: DataFrame, path: str, *, value: str = "value") -> DataFrame:
    """Rows of JSON texts, of which a sort field keeps one scalar type for good; nulls have none."""
    at = "$" + "".join(f"['{n}']" for n in path.split("."))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(value)), at, "variant"))
    kinds = rows.select(F.count_distinct(F.when(kind != "VOID", F.regexp_replace(kind, r"\(.*", "")))).scalar()
    return require(rows, kinds <= 1, f"sort field {path} has values of several types")


def top_n(rows: DataFrame, order_by: list[tuple[str, str]], n: int, *, partition_by: list[str] | None = None, ties: list[str], count: str | None = None) -> DataFrame:
    """The first n row occurrences of each group; with ``count`` a row stands for that many.

    The rank filter comes first: every count is at least 1, so rows beyond rank n cannot win, and
    Spark limits each group in the map tasks before the exchange. The cumulative cut then works on n
    rows a group. Without groups the map-side limit leaves n rows a task.
    """
    if not 1 <= n <= 10_000:
        raise ValueError("n is from 1 to 10000")
    group = partition_by or []
    for fields in (group, [f for f, _ in order_by]):
        if len(set(fields)) != len(fields) or not all(fields):
            raise ValueError("group and sort fields are named once each")
    rows = sortable(rows, [f for f, _ in order_by])
    w = Window.partitionBy(*group).orderBy(*ordering(order_by, ties))
    best = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    if count is None:
        return best.drop("_rank")
    before = F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("_before", before).filter(F.col("_before") < n)
    return best.withColumn(count, F.least(F.col(count), F.lit(n) - F.col("_before")).cast("long")).drop("_rank", "_before")


def deduplicate(records: DataFrame, *, key: str = "key", time: str = "event_time", sequence: str = "sequence", strict: bool = True) -> DataFrame:
    """The first record of each key by (time, sequence): one aggregation with partial results."""
    rows = keyed_additions(records, key) if strict else records.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    others = [c for c in records.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(time, sequence)).alias("_r")).select(key, "_r.*").select(*records.columns)


def deduplicate_outputs(records: DataFrame, *, key: str = "key", time: str = "event_time", sequence: str = "sequence") -> DataFrame:
    """Every record with ``suppressed`` and ``canonical``, the sequence of the record that stands for
    its key. The canonical sequence comes from an aggregation, joined on a unique key."""
    rows = keyed_additions(records, key)
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(time, sequence)).getField(sequence).alias("canonical"))
    return rows.join(first, F.col(key) == F.col("_k")).drop("_k").withColumn("suppressed", F.col(sequence) != F.col("canonical"))


def keyed_additions(records: DataFrame, key: str) -> DataFrame:
    rows = require(records, F.col(key).isNotNull() & (F.col(key).cast("string") != ""), "de-duplication needs a key")
    return require(rows, ~F.col("kind").isin("delete", "update_before"), "de-duplication takes no retractions") if "kind" in records.columns else rows


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, or an error if there are more than ``limit``; reads at most one row beyond it."""
    if not 1 <= limit <= 10_000:
        raise ValueError("a limit is from 1 to 10000")
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def winner_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Unit-weight changes from one set of winners to the next: losers leave (-1), then others enter."""
    leave = before.exceptAll(after).select("*", F.lit("delete").alias("kind"), F.lit(-1).cast("long").alias("diff"))
    enter = after.exceptAll(before).select("*", F.lit("insert").alias("kind"), F.lit(1).cast("long").alias("diff"))
    return leave.unionByName(enter)
