"""Null-safe joins. How a side travels is left to Spark, which knows its size at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Join condition in which a missing key matches a missing key."""
    condition = F.lit(True)
    for a, b in keys.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe left join that keeps ``left``'s columns and adds ``right``'s non-key columns."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = left.join(renamed, null_safe(left, renamed, {k: f"__{k}" for k in keys}), "left")
    return joined.drop(*[f"__{k}" for k in keys])
