"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long, keeping rows whose value is missing."""
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence, prefix: str = ""
) -> DataFrame:
    """Long to wide for the given levels; naming them avoids a job to find them."""
    return df.groupBy(*ids).agg(
        *[F.max(F.when(F.col(name) == lvl, F.col(value))).alias(f"{prefix}{lvl}") for lvl in levels]
    )
