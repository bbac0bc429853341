"""Changelogs: netting, folding into collections, normalisation by primary key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KINDS, require, weight

MODES = ("append", "upsert", "retract")


def fold(changes: DataFrame, identity: list[str], *, diff: str = "diff", strict: bool = True) -> DataFrame:
    """The collection that a changelog adds up to: each identity with its positive ``count``.

    One aggregation with partial sums. A negative count is an error where ``strict``.
    """
    total = changes.groupBy(*identity).agg(F.sum(diff).cast("long").alias("count"))
    if strict:
        total = require(total, F.col("count") >= 0, "a row was retracted more often than it was added")
    return total.filter("count > 0")


def net(records: DataFrame, identity: list[str]) -> DataFrame:
    """Records reduced to one per identity with its multiplicity, unmatched retractions dropped."""
    return fold(records.withColumn("diff", weight()), identity, strict=False)


def bag(records: DataFrame, identity: list[str], *, order: str = "sequence") -> DataFrame:
    """A collection without primary key: running multiplicities must never fall below 0."""
    w = Window.partitionBy(*identity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = records.withColumn("diff", weight()).withColumn("running", F.sum("diff").over(w))
    return fold(require(running, F.col("running") >= 0, "a retraction matches no row of the bag"), identity)


def checked(records: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown input mode {mode!r}")
    if mode == "append":
        return require(records, F.col("kind") == "insert", "an append-only input takes inserts alone")
    if mode == "upsert":
        return require(records, F.col("kind") != "update_before", "an upsert input takes no update_before")
    return records


def normalize(records: DataFrame, primary_key: list[str], payload: list[str], *, mode: str = "upsert", order: str = "sequence", time: str = "event_time", strict: bool = True) -> DataFrame:
    """The changelog of a keyed table: primary key, payload, ``event_time``, ``kind``, ``diff``,
    ``sequence``.

    Upserts: a row equal to the one before is no change and keeps the first time; another replaces it
    (the old row leaves with its own time). Retractions must match the row that is stored. Keys are
    independent, so the work is one exchange by key and windows within it.
    """
    if not primary_key or len(set(primary_key)) != len(primary_key):
        raise ValueError("primary key fields must be given once each")
    if mode == "append":
        raise ValueError("normalisation takes upsert or retract input")
    rows = checked(records, mode)
    for name in primary_key:
        rows = require(rows, F.col(name).isNotNull(), f"primary key field {name} is null")
    w = Window.partitionBy(*primary_key).orderBy(order)
    gone = F.col("_weight") < 0
    state = F.when(~gone, F.struct(*payload))
    rows = rows.withColumn("_weight", weight()).withColumn("_state", state)
    rows = rows.withColumn("_before", F.lag("_state").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    if strict:
        unknown = gone & F.col("_before").isNull()
        rows = require(rows, ~unknown, "a delete of an unknown primary key")
        if mode == "retract":
            rows = require(rows, gone | F.col("_before").isNull(), "an addition of a primary key that exists")
            rows = require(rows, ~gone | F.struct(*payload).eqNullSafe(F.col("_before")), "a retraction that does not match the stored row")
    moved = rows.filter(~F.col("_state").eqNullSafe(F.col("_before")))
    # Survivors follow each other again; the old row leaves with the time at which it came.
    moved = moved.withColumn("_old", F.lag(F.struct(F.col("_state").alias("state"), F.col(time).alias("at"))).over(w))
    out_row = lambda state, at, kind, diff: F.struct(state.alias("state"), at.alias("at"), F.lit(kind).alias("kind"), F.lit(diff).alias("diff"))
    leave, enter = F.col("_old.state").isNotNull(), F.col("_state").isNotNull()
    changes = F.filter(
        F.array(F.when(leave, out_row(F.col("_old.state"), F.col("_old.at"), "delete", -1)), F.when(enter, out_row(F.col("_state"), F.col(time), "insert", 1))), lambda c: c.isNotNull()
    )
    out = moved.select(*primary_key, F.col(order).alias("sequence"), F.explode(changes).alias("c"))
    return out.select(*primary_key, *[F.col(f"c.state.{p}").alias(p) for p in payload], F.col("c.at").alias("event_time"), "c.kind", F.col("c.diff").cast("long").alias("diff"), "sequence")


def current(records: DataFrame, primary_key: list[str], *, order: str = "sequence") -> DataFrame:
    """The last state of every key that is not deleted: one aggregation, no sort."""
    others = [c for c in records.columns if c not in primary_key]
    last = records.groupBy(*primary_key).agg(F.max_by(F.struct(*others), order).alias("_last"))
    live = last.filter(F.col("_last.kind").isin(*[k for k, v in KINDS.items() if v > 0]))
    return live.select(*primary_key, *[F.col(f"_last.{c}").alias(c) for c in others])


def running_changes(rows: DataFrame, key: list[str], emit: str, *, order: str = "sequence") -> DataFrame:
    """Per key: the first emitted value inserts, later ones update; nulls leave the output alone.

    Adds ``emitted``, ``kind`` and ``diff``; an update gives two rows.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    said = rows.withColumn("_old", F.last(emit, ignorenulls=True).over(w)).filter(F.col(emit).isNotNull())
    row = lambda v, kind, diff: F.struct(v.alias("emitted"), F.lit(kind).alias("kind"), F.lit(diff).cast("long").alias("diff"))
    first = F.array(row(F.col(emit), "insert", 1))
    later = F.array(row(F.col("_old"), "update_before", -1), row(F.col(emit), "update_after", 1))
    return said.withColumn("_c", F.explode(F.when(F.col("_old").isNull(), first).otherwise(later))).select(*[c for c in rows.columns if c != emit], "_c.*")
