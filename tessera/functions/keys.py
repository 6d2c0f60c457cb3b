"""Place keys: padding, levels, composition, names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv


def pad_code(code: Column, width: Column | int) -> Column:
    """Left-pad with zeros to ``width``.  Longer codes stay whole.

    Blanks anywhere in the code become zeros too, as in the padded originals.
    """
    target = F.greatest(F.length(code), F.lit(width) if isinstance(width, int) else width)
    return F.translate(F.lpad(code, target, "0"), " ", "0")


def widest(df: DataFrame, code: str) -> Column:
    """Longest length of ``code`` as a scalar subquery (one row, no join)."""
    return df.agg(F.max(F.length(code))).scalar()


def with_padded(df: DataFrame, code: str, width: int | None = None) -> DataFrame:
    """Pad one column to a given width, or to the longest value in it."""
    return df.withColumn(code, pad_code(F.col(code), widest(df, code) if width is None else width))


def level_key(key: Column, level: str, widths: Mapping[str, int] = fv.KEY_LEVELS) -> Column:
    """Key of the enclosing place at ``level`` (a prefix of the full key)."""
    return F.substring(key, 1, widths[level])


def with_levels(
    df: DataFrame, key: str, levels=tuple(fv.KEY_LEVELS), widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    return df.withColumns({level: level_key(F.col(key), level, widths) for level in levels})


def compose_block_key(
    df: DataFrame,
    county: str,
    tract: str,
    block: str,
    tract_width: int | None = None,
    block_width: int | None = None,
    out: str = "fips",
) -> DataFrame:
    """Full key from county, decimal tract number (two places) and block number."""
    whole_tract = (F.col(tract).cast("decimal(18,2)") * 100).cast("bigint").cast("string")
    parts = df.withColumns({"_tract": whole_tract, "_block": F.col(block).cast("string")})
    tract_code = pad_code(F.col("_tract"), tract_width or widest(parts, "_tract"))
    block_code = pad_code(F.col("_block"), block_width or widest(parts, "_block"))
    return parts.withColumn(out, F.concat(F.col(county), tract_code, block_code)).drop(
        "_tract", "_block"
    )


def short_name(name: Column) -> Column:
    """Text before the first hyphen; the whole name when that is empty."""
    head = F.substring_index(name, "-", 1)
    return F.when(head == "", name).otherwise(head)


def outside(code: Column, values) -> Column:
    """``code`` is not one of ``values``; a missing code counts as outside."""
    return code.isNull() | ~code.isin(*values) if values else F.lit(True)


def exclude_regions(
    df: DataFrame, key: str, states=(), metros=(), metro: str = "cbsa", widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    """Drop places by state prefix and rows by metro id, keeping missing ids."""
    kept = df.filter(outside(level_key(F.col(key), "state", widths), states)) if states else df
    return kept.filter(outside(F.col(metro), metros)) if metros else kept


def in_universe(state: Column) -> Column:
    """State code belongs to the contiguous universe."""
    return (state.try_cast("int") < fv.STATE_CODE_BOUND) & ~state.isin(*fv.STATES_OUTSIDE_UNIVERSE)


def universe_filter(
    df: DataFrame, key: str, renamed: str | None = None, widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    kept = df.filter(in_universe(level_key(F.col(key), "state", widths)))
    return kept.withColumnRenamed(key, renamed) if renamed else kept
