"""The record envelope, row kinds and stream policies that all operators share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row kinds and the weight of each in a changelog.
KINDS = {"insert": 1, "upsert": 1, "update_before": -1, "update_after": 1, "delete": -1}
WATERMARK_MODES = ("bounded", "monotonic", "source_managed")
LATE_POLICIES = ("drop", "side_output", "accept")

#: The columns of an envelope and their types; ``value`` is a struct, or JSON text.
ENVELOPE = (
    "stream string, partition int, offset long, sequence long, event_time timestamp_ntz, key string, kind string, "
    "event_id string, source_id string, source_partition int, source_offset long"
)


def weight(kind: Column | str = "kind") -> Column:
    """+1 for an addition, -1 for a retraction; any other kind is an error."""
    col = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(col.isin(*[k for k, w in KINDS.items() if w > 0]), F.lit(1))
        .when(col.isin(*[k for k, w in KINDS.items() if w < 0]), F.lit(-1))
        .otherwise(F.raise_error(F.concat(F.lit("unknown row kind "), F.coalesce(col, F.lit("null")))).cast("int"))
    )


@dataclass(frozen=True)
class StreamPolicy:
    """How a stream tells progress and treats late records. Times are in seconds."""

    partitions: int = 1
    watermark: str = "bounded"
    disorder: float = 5.0
    idle_timeout: float = 60.0
    lateness: float = 0.0
    late_policy: str = "side_output"
    drift: float | None = None

    def __post_init__(self):
        if self.partitions < 1:
            raise ValueError("a stream has at least one partition")
        if self.watermark not in WATERMARK_MODES:
            raise ValueError(f"unknown watermark mode {self.watermark!r}")
        if self.late_policy not in LATE_POLICIES:
            raise ValueError(f"unknown late policy {self.late_policy!r}")
        for name in ("disorder", "idle_timeout", "lateness"):
            value = getattr(self, name)
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{name} must be finite and not negative")
        if self.drift is not None and (not math.isfinite(self.drift) or self.drift < 0):
            raise ValueError("drift must be finite and not negative")

    @property
    def bound(self) -> float:
        """The disorder that the watermark allows for."""
        return 0.0 if self.watermark == "monotonic" else self.disorder


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a zone (as UTC)."""
    return F.unix_micros(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp"))


def seconds(value: float) -> int:
    """Seconds as whole microseconds."""
    return round(value * 1_000_000)


def field(path: str, value: str = "value") -> Column:
    """A field of a struct value by a path of names and dots; names are taken literally."""
    names = path.split(".")
    if not all(names):
        raise ValueError(f"empty name in path {path!r}")
    col = F.col(value)
    for name in names:
        col = col.getField(name)
    return col


def json_field(path: str, value: str = "value", kind: str = "string") -> Column:
    """A field of a JSON text; missing fields and values of another type are null."""
    if not all(path.split(".")):
        raise ValueError(f"empty name in path {path!r}")
    return F.try_variant_get(F.try_parse_json(F.col(value)), "$" + "".join(f"['{n}']" for n in path.split(".")), kind)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, with an error at run time for one that breaks the condition."""
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
