"""Temporal (as-of) and interval joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import micros, seconds


def as_of(probes: DataFrame, versions: DataFrame, *, key: str = "key", version_key: str | None = None, time: str = "event_time", sequence: str = "sequence", how: str = "inner", version_columns: list[str] | None = None, retracting: bool = False, ranges: int = 64, hot_rows: int = 100_000) -> DataFrame:
    """Each probe with the version of its key that held at its time, prefixed ``version_``.

    The version is the last by (time, sequence) at or before the probe; if that one is a retraction
    there is no match. Probes and versions are one sorted stream per key, so the cost is one exchange
    and one sort however many versions a key has; no pair is built. With ``retracting``, a negative
    probe takes one equal probe before it away (equal in all but ``sequence`` and ``kind``).

    A key of over ``hot_rows`` rows is cut into ``ranges`` of its time, and a task holds its rows of one
    range. The largest such keys are, four for each shuffle partition, so that any key is among them that
    has more than a quarter of what a task should get, and what is known about them is small: which they
    are, and the last version of each of their ranges, summed up with partial results and carried over
    the ranges. Where there is no such key, Spark leaves these steps out when it sees that.
    """
    if how not in ("inner", "left"):
        raise ValueError("an as-of join is inner or left")
    if retracting:
        kept = netted(probes, [c for c in probes.columns if c not in (sequence, "kind")], order=sequence)
        probes = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("_copy", "count")
    version_key = version_key or key
    columns = version_columns if version_columns is not None else [c for c in versions.columns if c not in (version_key,)]
    held = F.struct(*[F.col(c) for c in columns])
    removed = F.col("kind").isin("delete", "update_before") if "kind" in versions.columns else F.lit(False)
    p = probes.filter(F.col(key).isNotNull())
    right = versions.filter(F.col(version_key).isNotNull()).select(F.col(version_key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(sequence).alias("_s"), F.struct(held.alias("row"), removed.alias("removed")).alias("_version"))
    probe_type = p.select(F.struct(*p.columns).alias("x")).schema["x"].dataType
    right = right.withColumn("_probe", F.lit(None).cast(probe_type))
    left = p.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(sequence).alias("_s"), F.lit(None).cast(right.schema["_version"].dataType).alias("_version"), F.struct(*p.columns).alias("_probe"))
    rows = right.unionByName(left)
    at, spans = micros("_t"), max(ranges, 1)
    most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high"))
    hot = sizes.filter(F.col("_n") > hot_rows).orderBy(F.desc("_n"), "_k").limit(most).drop("_n")
    place = F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * spans).cast("int")
    rows = rows.join(F.broadcast(hot), "_k", "left").withColumn("_range", F.coalesce(place, F.lit(0))).drop("_low", "_high")
    large = rows.join(F.broadcast(hot), "_k", "left_semi")
    last = large.groupBy("_k", "_range").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_version")), F.when(F.col("_side") == 0, F.struct("_t", "_s"))).alias("_end"))
    over = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_k", "_range", F.last("_end", ignorenulls=True).over(over).alias("_carried"))
    w = Window.partitionBy("_k", "_range").orderBy("_t", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_inside", F.last("_version", ignorenulls=True).over(w)).filter("_side = 1")
    found = found.join(F.broadcast(carried), ["_k", "_range"], "left").withColumn("_last", F.coalesce("_inside", "_carried"))
    hit = F.col("_last").isNotNull() & ~F.col("_last.removed")
    if how == "inner":
        found = found.filter(hit)
    value = F.when(hit, F.col("_last.row"))
    return found.select("_probe.*", *[value.getField(c).alias(f"version_{c}") for c in columns])


@dataclass(frozen=True)
class Interval:
    """Bounds of right time minus left time, in seconds, inclusive."""

    lower: float
    upper: float

    def __post_init__(self):
        if not self.lower <= self.upper:
            raise ValueError("the lower bound is above the upper one")


def interval(left: DataFrame, right: DataFrame, bounds: Interval, *, key: str = "key", time: str = "event_time", buckets: bool = True) -> DataFrame:
    """Pairs of equal key with left.time + lower <= right.time <= left.time + upper.

    Columns are prefixed ``left_`` and ``right_``; ``event_time`` is the later time. With ``buckets``,
    time is cut into ranges as wide as the interval and the join is on key and range: a key of very
    many records is spread over its ranges instead of pairing with all of itself. A row of the left
    looks at the two or so ranges that its interval touches.
    """
    low, high = seconds(bounds.lower), seconds(bounds.upper)
    l = left.filter(F.col(key).isNotNull()).select(*[F.col(c).alias(f"left_{c}") for c in left.columns]).withColumn("_lt", micros(f"left_{time}"))
    r = right.filter(F.col(key).isNotNull()).select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withColumn("_rt", micros(f"right_{time}"))
    on = (F.col(f"left_{key}") == F.col(f"right_{key}")) & F.col("_rt").between(F.col("_lt") + F.lit(low), F.col("_lt") + F.lit(high))
    if buckets:
        size = F.lit(max(high - low, 1_000_000))
        l = l.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_lt") + low) / size), F.floor((F.col("_lt") + high) / size))))
        r = r.withColumn("_rb", F.floor(F.col("_rt") / size))
        on = on & (F.col("_b") == F.col("_rb"))
    pairs = l.join(r, on)
    return pairs.withColumn("event_time", F.greatest(f"left_{time}", f"right_{time}")).drop("_lt", "_rt", "_b", "_rb")


def interval_self(records: DataFrame, bounds: Interval, *, key: str = "key", time: str = "event_time", sequence: str = "sequence", any_order: bool = False) -> DataFrame:
    """Pairs of one stream: the left record is strictly earlier in time and, unless ``any_order``, was
    admitted earlier too."""
    if bounds.lower < 0:
        raise ValueError("a self-join looks forward: lower must not be negative")
    pairs = interval(records, records, bounds, key=key, time=time)
    pairs = pairs.filter(F.col(f"left_{time}") < F.col(f"right_{time}"))
    return pairs if any_order else pairs.filter(F.col(f"left_{sequence}") < F.col(f"right_{sequence}"))


def netted(records: DataFrame, identity: list[str], *, order: str = "sequence") -> DataFrame:
    """Records left after each retraction took one equal record before it away, with their ``count``;
    retractions that meet none are ignored.

    What is open is a running sum that never falls below zero: the sum less the least sum so far.
    """
    negative = F.col("kind").isin("delete", "update_before")
    upto = Window.partitionBy(*identity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = records.select(*identity, order, F.when(negative, -1).otherwise(1).alias("_d")).withColumn("_sum", F.sum("_d").over(upto))
    open_ = (F.sum("_d") - F.least(F.lit(0), F.min("_sum"))).cast("int")
    return rows.groupBy(*identity).agg(open_.alias("count"), F.max(order).alias(order)).filter("count > 0")


def diff_join(left: DataFrame, right: DataFrame, bounds: Interval, *, key: str = "key", time: str = "event_time") -> DataFrame:
    """Interval join of two changelogs: pairs carry the product of the ``diff`` of both sides."""
    pairs = interval(left, right, bounds, key=key, time=time)
    return pairs.withColumn("diff", F.col("left_diff") * F.col("right_diff"))
