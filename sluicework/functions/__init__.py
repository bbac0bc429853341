"""Scalar functions that operators offer beside Spark's own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def group_key(*columns: str) -> Column:
    """The key of a group as a JSON array of its values: ``["a"]``, ``[null]``, ``[]``."""
    if not columns:
        return F.lit("[]")
    inner = [F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', "$1"), F.lit("null")) for c in columns]
    inner = [F.when(F.col(c).isNull(), F.lit("null")).otherwise(i) for c, i in zip(columns, inner, strict=True)]
    return F.concat(F.lit("["), F.concat_ws(",", *inner), F.lit("]"))


def fnv1a(text: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in text:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def key_group(key: Column, groups: int) -> Column:
    """The placement group of a key: FNV-1a modulo the number of groups, a null key in group 0."""

    @F.pandas_udf("long")
    def hashed(keys: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(keys)
        found = np.array([fnv1a(k.encode()) % groups for k in distinct] + [0])
        return pd.Series(found[codes])

    return hashed(key)
