"""Joins on keys of which any may be null: two null keys are one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` where all ``keys`` are equal or both null; the keys come from the left, other columns from both."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    if how in ("left_semi", "left_anti"):
        return left.join(named, match, how)
    return left.join(named, match, how).drop(*[f"_right_{k}" for k in keys])
