"""Sector codes: labels, harmonised codes, compound ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import lookup


def sector_label(df: DataFrame, new_column: bool = False, code: str = "naics") -> DataFrame:
    """Put the label in place of the code, or beside it as ``<code>_label``."""
    target = f"{code}_label" if new_column else code
    labelled = df.withColumn(target, lookup(F.col(code), fv.SECTOR_LABELS))
    front = [c for c in labelled.columns if c.startswith(code)]
    return labelled.select(*front, *[c for c in labelled.columns if c not in front])


def harmonise_sector(code: Column) -> Column:
    """First-source sector code in the coding of the second source."""
    bare = F.regexp_replace(code, "naics_", "")
    return F.concat(F.lit("naics_"), lookup(bare, fv.HARMONISED_SECTORS, otherwise=bare))


def second_source_sector(industry: Column) -> Column:
    """``RE..`` industry code as a sector code; all government codes are one."""
    code = F.regexp_replace(industry, "RE", "naics_")
    return F.when(F.substring(code, 7, 2) == "GV", F.lit("naics_GV")).otherwise(code)


def split_id(df: DataFrame, source: str, parts=("industry", "sep", "geo"), mark: str = "A") -> DataFrame:
    """Split a compound id; surplus pieces are dropped, missing ones are NULL."""
    pieces = F.split(F.col(source), mark)
    return df.withColumns({name: F.get(pieces, i) for i, name in enumerate(parts)}).drop(source)
