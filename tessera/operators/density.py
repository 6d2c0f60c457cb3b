"""Densities over land area, and the ranking of places by density."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import ratio
from tessera.functions.keys import level_key
from tessera.operators.joins import attach, members
from tessera.operators.rollup import rollup
from tessera.operators.selection import select_tiles

METRO_COLUMNS = ("stcofips", "cbsa", "cbsa_name")


def compute_density(
    df: DataFrame,
    measure: str,
    crosswalk: DataFrame,
    unit: str = "tract",
    carry: Sequence[str] = (),
    metro: Sequence[str] = ("cbsa", "cbsa_name"),
    widths: Mapping[str, int] = fv.KEY_LEVELS,
) -> DataFrame:
    """Density of a chosen measure with the metro of the place's county.

    Counties outside the crosswalk keep a missing metro.  ``carry`` takes further
    measures along so that nothing has to be joined back later.
    """
    kept = [c for c in (unit, "year", measure, "ALAND_SQMI") if c in df.columns]
    dense = df.select(
        *kept,
        *[c for c in carry if c not in kept],
        ratio(measure, "ALAND_SQMI").alias("density"),
        level_key(F.col(unit), "county", widths).alias("stcofips"),
    )
    return attach(dense, crosswalk.select("stcofips", *metro), "stcofips").drop("stcofips")


def compute_block_density(
    counts: DataFrame,
    block_area: DataFrame,
    measure: str,
    crosswalk: DataFrame,
    metro: str | None = None,
    widths: Mapping[str, int] = fv.KEY_LEVELS,
) -> DataFrame:
    """The same at block-group level, with areas rolled up from blocks.

    ``metro`` keeps the block groups of one metro; the filter reaches both inputs
    before they are summed.
    """
    if metro is not None:
        counties = crosswalk.filter(F.col("cbsa") == metro)
        counts, block_area = (
            members(t.withColumn("_cty", level_key(F.col("fips"), "county", widths)), "_cty", counties, "stcofips").drop("_cty")
            for t in (counts, block_area)
        )
    by = [c for c in ("year",) if c in counts.columns]
    jobs = rollup(counts, "fips", "blkgrp", by, [measure], widths=widths)
    area = rollup(block_area, "fips", "blkgrp", (), ["ALAND_SQMI"], widths=widths)
    return compute_density(attach(jobs, area, "blkgrp"), measure, crosswalk, unit="blkgrp", widths=widths)


def density_tiles(
    df: DataFrame,
    unit: str = "tract",
    group: Sequence[str] = ("cbsa", "year"),
    tiles: Sequence[int] = fv.TILE_COUNTS,
    method: str = "large_first",
    metro_total: str | None = None,
) -> DataFrame:
    """Tiles of density inside metro and year; places without a metro are one group.

    ``metro_total`` names a measure whose sum over the whole group is added as
    ``metro_total``; it comes out of the first pass for free.  Places are read three times:
    stage them if they are costly.
    """
    totals = {"metro_total": metro_total} if metro_total else None
    return select_tiles(df, tiles, group, "density", [unit], method, totals)
