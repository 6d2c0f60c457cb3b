"""Comparison of two employment sources.

Counts are rolled up to counties first; everything after that works on one row per
county, or per county and sector.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import family, prefix_numbered, ratio, sector_columns, total
from tessera.functions.keys import short_name
from tessera.functions.sectors import harmonise_sector, second_source_sector, split_id
from tessera.operators.joins import attach
from tessera.operators.rollup import rollup

DELTAS = ("m_tot", "delta", "percent_delta")


def county_counts(counts: DataFrame, widths: Mapping[str, int] = fv.KEY_LEVELS) -> DataFrame:
    """First source by county, all numeric columns."""
    return rollup(counts.drop("year"), "fips", "county", (), out="stcofips", widths=widths)


def prepare_second_source(raw: DataFrame, low: int = 2002, high: int = 2016) -> tuple[DataFrame, DataFrame]:
    """Second source as (all-industries rows, sums per county and sector)."""
    split = prefix_numbered(split_id(raw, "DBcode"), 1970, 2016)
    years = family(split, numbered=("y", low, high))
    emp = split.select("stcofips", "industry", *years)
    totals = emp.filter(F.col("industry") == fv.ALL_INDUSTRIES)
    sectors = (
        emp.filter(F.col("industry") != fv.ALL_INDUSTRIES)
        .withColumn("naics", second_source_sector(F.col("industry")))
        .groupBy("stcofips", "naics")
        .agg(*[total(y).alias(y) for y in years])
    )
    return totals, sectors


def with_deltas(df: DataFrame, count: str, thousands: str, guarded: bool = False) -> DataFrame:
    """Second source in units, difference, and difference relative to it."""
    compared = df.withColumn("m_tot", F.col(thousands) * 1000)
    compared = compared.withColumn("delta", F.col(count) - F.col("m_tot"))
    relative = ratio("delta", "m_tot")
    if guarded:
        relative = F.when(F.col("m_tot") > 0, relative).when(F.col("m_tot") <= 0, 0.0)
    return compared.withColumn("percent_delta", relative)


def county_check(counties: DataFrame, totals: DataFrame, year: int) -> DataFrame:
    """County totals of both sources; counties without a second value drop out."""
    y = f"y{year}"
    joined = attach(
        counties.select("stcofips", "job_tot"), totals.select("stcofips", y), "stcofips"
    )
    return with_deltas(joined, "job_tot", y).filter(F.col("m_tot").isNotNull())


def overall_check(check: DataFrame) -> DataFrame:
    """One row: summed difference, and its ratio to the second source."""
    return check.agg(total("delta").alias("delta"), total("m_tot").alias("m_tot")).withColumn(
        "percent_delta", ratio("delta", "m_tot")
    )


def sectors_of_counties(counties: DataFrame, sectors: DataFrame, year: int) -> DataFrame:
    """County by sector rows of the first source with the second source attached."""
    y = f"y{year}"
    long = counties.select("stcofips", "job_tot", *sector_columns(counties)).unpivot(
        ["stcofips", "job_tot"], sector_columns(counties), "naics", "jobs"
    )
    harmonised = long.withColumn("naics", harmonise_sector(F.col("naics")))
    return harmonised.join(sectors.select("stcofips", "naics", y), ["stcofips", "naics"], "left")


def sector_check(counties: DataFrame, sectors: DataFrame, year: int) -> DataFrame:
    """National totals per sector; unmatched sectors show zero in the second source."""
    y = f"y{year}"
    summed = (
        sectors_of_counties(counties, sectors, year)
        .groupBy("naics")
        .agg(total("jobs").alias("jobs"), total(y).alias(y))
    )
    return (
        with_deltas(summed, "jobs", y)
        .withColumn("short_name", F.regexp_replace("naics", "naics_", ""))
        .filter(F.col("m_tot").isNotNull() & (F.col("naics") != fv.UNCOMPARABLE_SECTOR))
    )


def metro_check(counties: DataFrame, totals: DataFrame, crosswalk: DataFrame, year: int) -> DataFrame:
    """Metro totals of both sources, for metros with a top county."""
    y = f"y{year}"
    placed = attach(
        attach(counties.select("stcofips", "job_tot"), totals.select("stcofips", y), "stcofips"),
        crosswalk.select("stcofips", "cbsa", "top100"),
        "stcofips",
    )
    summed = placed.groupBy("cbsa").agg(
        total("job_tot").alias("job_tot"), total(y).alias(y), total("top100").alias("top100")
    )
    return named_metros(with_deltas(summed, "job_tot", y).filter(F.col("top100") > 0), crosswalk)


def named_metros(df: DataFrame, crosswalk: DataFrame) -> DataFrame:
    names = crosswalk.select("cbsa", "cbsa_name").distinct()
    return attach(df, names, "cbsa").withColumn("short_name", short_name(F.col("cbsa_name")))


def metro_sector_check(
    counties: DataFrame,
    sectors: DataFrame,
    crosswalk: DataFrame,
    year: int,
    guarded: bool = True,
) -> DataFrame:
    """Top metros by sector.  ``guarded`` shows 0 where the second source has nothing."""
    y = f"y{year}"
    placed = attach(
        sectors_of_counties(counties, sectors, year),
        crosswalk.filter(F.col("top100") == 1).select("stcofips", "cbsa", "top100"),
        "stcofips",
    ).filter(F.col("top100") == 1)
    summed = placed.groupBy("cbsa", "naics").agg(
        total("job_tot").alias("job_tot"), total("jobs").alias("jobs"), total(y).alias(y)
    )
    compared = with_deltas(summed, "jobs", y, guarded).withColumn(
        "delta_share",
        F.when(F.col("job_tot") > 0, ratio("delta", "job_tot")).when(
            F.col("job_tot") <= 0, 0.0
        ),
    )
    return named_metros(compared, crosswalk)


def wide_gap(metros: DataFrame, limit: Column | float) -> DataFrame:
    """Flag metros whose relative gap is wider than ``limit`` in either direction.

    ``limit`` is a number, or the national ratio as a scalar subquery:
    ``overall_check(check).select("percent_delta").scalar()``.
    """
    bound = F.abs(F.lit(limit) if isinstance(limit, float) else limit)
    wide = F.abs(F.col("percent_delta")) > bound
    return metros.withColumn("wide_gap", F.when(wide, 1).when(~wide, 0))


def side_by_side(check: DataFrame, ids=("naics", "short_name"), counts=("jobs", "m_tot")) -> DataFrame:
    """Both measures long, as a grouped bar chart needs them."""
    typed = check.select(*ids, *[F.col(c).cast("double").alias(c) for c in counts])
    return typed.unpivot(list(ids), list(counts), "source", "job_ct")
