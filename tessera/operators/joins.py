"""Equi-joins with the semantics the analyses need.

No side is forced to broadcast: Spark broadcasts the dimension when its size is
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import stage


def join_nullsafe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` where a missing key equals a missing key; keys appear once."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def join_summary(
    left: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Null-safe join of a small aggregate back to the many rows it came from.

    The aggregate is staged first.  Then its true size is known when the join is
    planned: it is broadcast under the threshold, without shuffling the many rows on
    a key with few values, and is shuffled otherwise.
    """
    return join_nullsafe(left, stage(summary, "summary"), keys, how)


def attach(left: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join of dimension attributes on one key."""
    return left.join(dimension, key, "left")


def merge_periods(
    first: DataFrame,
    second: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str],
    how: str = "inner",
) -> DataFrame:
    """Two snapshots side by side; columns other than keys get the suffixes."""

    def suffixed(df, suffix):
        return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys})

    left, right = suffixed(first, suffixes[0]), suffixed(second, suffixes[1])
    if how != "full":
        return join_nullsafe(left, right, keys, how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, match, "full")
    return joined.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys}).drop(*[f"_r_{k}" for k in keys])


def members(df: DataFrame, key: str, listed: DataFrame, listed_key: str | None = None) -> DataFrame:
    """Rows whose key is in the list."""
    return df.join(listed.select(F.col(listed_key or key).alias(key)), key, "left_semi")


def non_members(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the list; rows with a missing key stay."""
    return df.join(listed.select(*keys), list(keys), "left_anti")
