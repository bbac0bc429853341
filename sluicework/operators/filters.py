"""Filters: one predicate on one field, passing records with their row kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import field

COMPARISONS = ("equal", "not_equal", "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal")


def predicate(value: Column, comparison: str, operand, present: Column | None = None) -> Column:
    """A comparison that is false, never null, where the field is missing.

    ``present`` tells whether the field exists; by default it does where it is not null. An explicit
    null equals a null operand. Ordered comparisons hold between numbers alone; texts and booleans
    know only equality.
    """
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}")
    # Where presence means not null, the comparison cannot be null: it stays plain, for push-down.
    exists = value.isNotNull() if present is None else present
    sure = (lambda c: c) if present is None else (lambda c: F.coalesce(c, F.lit(False)))
    if comparison in ("equal", "not_equal"):
        same = value.isNull() if operand is None else sure(value == F.lit(operand))
        return exists & (same if comparison == "equal" else ~same)
    if isinstance(operand, bool) or not isinstance(operand, (int, float)):
        return F.lit(False)
    sign = {"greater_than": value > operand, "greater_than_or_equal": value >= operand, "less_than": value < operand, "less_than_or_equal": value <= operand}[comparison]
    return exists & sure(sign)


def filter_records(records: DataFrame, path: str, comparison: str, operand, *, value: str = "value") -> DataFrame:
    """Records whose field satisfies the comparison; the filter stays a plain predicate, so that it is
    pushed to the scan."""
    return records.filter(predicate(field(path, value), comparison, operand))


def filter_json(records: DataFrame, path: str, comparison: str, operand, *, value: str = "value") -> DataFrame:
    """The same for values that are JSON texts: a present null counts, other types do not compare."""
    variant = F.try_parse_json(F.col(value))
    where = "$" + "".join(f"['{n}']" for n in path.split("."))
    raw = F.try_variant_get(variant, where, "variant")
    kind = F.schema_of_variant(raw)
    if isinstance(operand, bool):
        typed, fits = F.try_variant_get(variant, where, "boolean"), kind == "BOOLEAN"
    elif isinstance(operand, (int, float)):
        # Integers equal integers and floats equal floats; ordered comparisons take both as numbers.
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        whole = kind == "BIGINT"
        fits = number if comparison not in ("equal", "not_equal") else (whole if isinstance(operand, int) else number & ~whole)
        typed = F.try_variant_get(variant, where, "double")
    else:
        typed, fits = F.try_variant_get(variant, where, "string"), kind == "STRING"
    present = raw.isNotNull()
    if operand is None:
        null = F.is_variant_null(raw)
        return records.filter(present & (null if comparison == "equal" else ~null if comparison == "not_equal" else F.lit(False)))
    comparable = F.when(fits, typed)
    return records.filter(present & predicate(comparable, comparison, operand, F.lit(True)))
