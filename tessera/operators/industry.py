"""Sector tables and location quotients.

Sectors stay wide while rows are many: sums are taken over the wide columns and
only the summed rows are turned long, so the shuffles do not grow by the number of
sectors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import ratio, ratio_sql, sector_columns, total_sql
from tessera.functions.keys import exclude_regions
from tessera.functions.sectors import sector_label
from tessera.operators.clusters import expand_definitions
from tessera.operators.reshape import to_wide
from tessera.operators.rollup import total_row


def industry_long(
    df: DataFrame, states: Sequence[str] = fv.EXCLUDED_STATES, widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    """One row per place, year and sector, excluded states left out."""
    kept = exclude_regions(df, "tract", states, widths=widths)
    return kept.select("tract", "year", "job_tot", "ALAND_SQMI", *sector_columns(df)).unpivot(
        ["tract", "year", "job_tot", "ALAND_SQMI"], sector_columns(df), "naics", "jobs"
    )


def sector_totals(
    df: DataFrame, years: tuple[int, int], states: Sequence[str] = fv.EXCLUDED_STATES,
    widths: Mapping[str, int] = fv.KEY_LEVELS,
) -> DataFrame:
    """National counts and shares per sector in two years, with their changes."""
    first, second = years
    sectors = sector_columns(df)
    kept = exclude_regions(df, "tract", states, widths=widths).filter(F.col("year").isin(*years))
    sums = kept.agg(
        *[
            F.expr(f"{total_sql(f'CASE WHEN year = {y} THEN {s} END')} AS {s}_{y}")
            for y in years
            for s in sectors
        ]
    )
    rows = ", ".join(
        f"named_struct('naics', '{s}', 'emp_{first}', {s}_{first}, 'emp_{second}', {s}_{second})"
        for s in sectors
    )
    whole = [f"{' + '.join(f'{s}_{y}' for s in sectors)} AS tot_{y}" for y in years]
    share = {y: f"({ratio_sql(f'emp_{y}', f'tot_{y}')}) * 100" for y in years}
    return (
        sums.selectExpr(*whole, f"inline(array({rows}))")
        .selectExpr("*", *[f"{share[y]} AS share_{y}" for y in years])
        .selectExpr(
            "naics",
            f"emp_{first}",
            f"share_{first}",
            f"emp_{second}",
            f"share_{second}",
            f"emp_{second} - emp_{first} AS job_change",
            f"share_{second} - share_{first} AS share_change",
        )
    )


def industry_totals(
    df: DataFrame, years: tuple[int, int], states: Sequence[str] = fv.EXCLUDED_STATES,
    widths: Mapping[str, int] = fv.KEY_LEVELS,
) -> DataFrame:
    """The national sector table with labels and a total row."""
    return total_row(sector_label(sector_totals(df, years, states, widths), new_column=True), "naics")


def industry_cluster_shares(
    profile: DataFrame,
    years: tuple[int, int],
    minimums: Sequence[float] = fv.NATIONAL_MINIMUMS,
    cut: str = "mapvar_10",
) -> DataFrame:
    """Sector mix inside clusters of one cut, per minimum share, years side by side.

    ``profile`` is keyed by year and carries the sector sums.
    """
    sectors = sector_columns(profile)
    in_clusters = (
        expand_definitions(profile.filter(F.col("year").isin(*years)), minimums, [cut])
        .filter(F.col("mapvar") == "cluster")
        .groupBy("year", "pp_min")
        .agg(*[F.expr(f"{total_sql(c)} AS {c}") for c in ("job_tot", *sectors)])
    )
    shares = in_clusters.select(
        "year", "pp_min", *[(ratio(s, "job_tot") * 100).alias(s) for s in sectors]
    ).unpivot(["year", "pp_min"], sectors, "naics", "share")
    return to_wide(shares, ["naics", "pp_min"], "year", "share", years, prefix="x")


def location_quotient(cluster_shares: DataFrame, totals: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Cluster share over national share per sector, with labels."""
    national = totals.select("naics", *[f"share_{y}" for y in years])
    joined = cluster_shares.join(national, "naics", "left")
    return sector_label(
        joined.withColumns({f"lq_{y}": ratio(f"x{y}", f"share_{y}") for y in years}),
        new_column=True,
    )
