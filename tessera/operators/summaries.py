"""National and metro tables from an expanded cluster profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import lookup, ratio, total_sql
from tessera.operators.joins import members
from tessera.operators.lookup import top_metros
from tessera.operators.selection import select_quantiles


def national_clusters(
    defined: DataFrame, counted: str = "true", restrict_numerator: bool = False
) -> DataFrame:
    """Jobs in clusters and their share of all jobs, per year, cut and minimum.

    ``counted`` is a condition for the profile rows that make up "all jobs".  Clusters
    outside it still count in the numerator, as in the published second form, unless
    ``restrict_numerator`` is set.  Definitions without any cluster have no row.
    """
    cluster = f"mapvar = 'cluster' AND ({counted})" if restrict_numerator else "mapvar = 'cluster'"
    return (
        defined.groupBy("year", "num_quant", "pp_min")
        .agg(
            F.expr(f"{total_sql(f'CASE WHEN {cluster} THEN job_tot END')} AS jobs"),
            F.expr(f"{total_sql(f'CASE WHEN {counted} THEN job_tot END')} AS all_jobs"),
            F.expr(f"{total_sql(f'CASE WHEN {cluster} THEN _units END')} AS units"),
        )
        .filter("units > 0")
        .select(
            "year",
            lookup(F.col("num_quant"), fv.NATIONAL_CUT_NAMES).alias("Density"),
            F.col("pp_min").alias("Minimum job share"),
            F.col("jobs").alias("Jobs in clusters"),
            (ratio("jobs", "all_jobs") * 100).alias("% of jobs in clusters"),
        )
    )


def two_periods(
    df: DataFrame,
    keys: Sequence[str],
    periods: tuple[int, int],
    suffixes: tuple[str, str],
    period: str = "year",
) -> DataFrame:
    """Rows of two periods side by side, for keys that have both.

    Same result as joining the two slices, from one pass over the table.  A missing
    key is a key like any other.
    """
    values = [c for c in df.columns if c not in (*keys, period)]
    wanted = [
        F.expr(f"max(CASE WHEN {period} = {p} THEN `{v}` END) AS `{v}{suffix}`")
        for p, suffix in zip(periods, suffixes)
        for v in values
    ]
    present = [F.expr(f"count_if({period} = {p}) AS _has{i}") for i, p in enumerate(periods)]
    return (
        df.filter(F.col(period).isin(*periods))
        .groupBy(*keys)
        .agg(*present, *wanted)
        .filter("_has0 > 0 AND _has1 > 0")
        .drop("_has0", "_has1")
    )


def metro_summary(defined: DataFrame, metros: DataFrame) -> DataFrame:
    """Counts per metro, year, cut and minimum, for the listed metros only."""
    counts = {
        "jobs": total_sql("job_tot"),
        "cluster_jobs": total_sql("CASE WHEN mapvar = 'cluster' THEN job_tot END"),
        "tr_ct": "sum(_units)",
        "high_ct": total_sql("CASE WHEN mapvar = 'high density' THEN _units END"),
        "cluster_ct": total_sql("CASE WHEN mapvar = 'cluster' THEN _units END"),
    }
    summed = defined.groupBy("cbsa", "year", "num_quant", "pp_min").agg(
        *[F.expr(f"{text} AS {name}") for name, text in counts.items()]
    )
    return summed.join(metros.select("cbsa", "cbsa_name"), "cbsa").select(
        "cbsa",
        "cbsa_name",
        "year",
        "num_quant",
        F.col("pp_min").alias("min"),
        "jobs",
        "cluster_jobs",
        "tr_ct",
        "high_ct",
        "cluster_ct",
    )


def metro_shares(summary: DataFrame) -> DataFrame:
    """Derived shares, and the display name of the cut."""
    return summary.withColumns(
        {
            "cluster_share": ratio("cluster_ct", "tr_ct"),
            "job_share": ratio("cluster_jobs", "jobs") * 100,
            "num_quant": lookup(F.col("num_quant"), fv.METRO_CUT_NAMES),
        }
    )


def metro_thresholds(
    df: DataFrame,
    crosswalk: DataFrame,
    unit: str = "tract",
    percentiles: Mapping[str, float] = fv.THRESHOLD_PERCENTILES,
) -> DataFrame:
    """Density cut-points of the top metros, long, per year.

    Other metros are dropped before anything is counted.  ``unit`` is not needed any more.
    """
    metros = top_metros(crosswalk)
    cuts = select_quantiles(members(df, "cbsa", metros), ["cbsa", "year"], ["density"], percentiles)
    return (
        cuts.join(metros, "cbsa")
        .unpivot(["cbsa", "cbsa_name", "year"], list(percentiles), "percentile", "n")
    )
