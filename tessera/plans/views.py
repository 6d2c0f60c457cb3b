"""Parameterised dashboard queries over precomputed tables.

``categories`` is the precomputed table of places: one row per place and year with
its category under each cut and ``metro_total``.  As ``dashboard.build`` keeps it, it is
partitioned by year and ordered by metro, so a view reads little of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import total
from tessera.operators.clusters import apply_minimum_sql, named_minimum
from tessera.operators.geo import geo_attribute_join
from tessera.operators.joins import members
from tessera.operators.stats import density_curve


def cluster_view(
    categories: DataFrame,
    bounds: DataFrame,
    cbsa_name: str,
    year: int,
    choice: int,
    minimum: float,
    unit: str = "tract",
) -> DataFrame:
    """Map rows of one metro and year under one cut and minimum share."""
    cut = fv.CUT_CHOICES[choice]
    least = f"metro_total * {named_minimum(minimum)[1]}D"
    units = categories.filter((F.col("cbsa_name") == cbsa_name) & (F.col("year") == year)).select(
        unit,
        "job_tot",
        "density",
        "ALAND_SQMI",
        F.expr(apply_minimum_sql(cut, "job_tot", least)).alias("mapvar"),
    )
    return geo_attribute_join(units, bounds, unit)


def overview_table(shares: DataFrame, cbsa_name: str, year: int) -> DataFrame:
    """Table under the map: clusters of one metro and year, all definitions."""
    return (
        shares.filter((F.col("cbsa_name") == cbsa_name) & (F.col("year") == year))
        .orderBy("min", "num_quant")
        .select(
            F.col("num_quant").alias("Density threshold"),
            F.col("min").alias("Min % jobs"),
            F.col("cluster_jobs").alias("Jobs in clusters"),
            F.col("cluster_ct").alias("Number of clusters"),
            F.col("job_share").alias("% jobs in clusters"),
        )
    )


def describe_metro(shares: DataFrame, centres: DataFrame, cbsa_name: str, year: int) -> DataFrame:
    """Headline numbers of one metro and year, with the map centre."""
    headline = (
        shares.filter((F.col("cbsa_name") == cbsa_name) & (F.col("year") == year))
        .groupBy("cbsa", "cbsa_name", "year")
        .agg(F.max("tr_ct").alias("tr_ct"), F.max("jobs").alias("jobs"))
    )
    return headline.join(centres.select("cbsa", "lat", "lon"), "cbsa", "left")


def headline(places: DataFrame, metros: DataFrame, centres: DataFrame, cbsa_name: str, year: int) -> DataFrame:
    """The same from one row per place: a count and a sum, nothing is ranked."""
    one = places.filter((F.col("cbsa_name") == cbsa_name) & (F.col("year") == year))
    summed = members(one, "cbsa", metros).groupBy("cbsa", "cbsa_name", "year").agg(
        F.count("*").alias("tr_ct"), total("job_tot").alias("jobs")
    )
    return summed.join(centres.select("cbsa", "lat", "lon"), "cbsa", "left")


def distribution_view(
    places: DataFrame, thresholds: DataFrame, by=("cbsa", "year"), unit=("tract",)
) -> DataFrame:
    """Density curve of each metro and year with the three cut-points beside it."""
    curve = density_curve(places.filter(F.col("cbsa").isNotNull()), "density", by, unit)
    marks = thresholds.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("percentile") == p, F.col("n"))).alias(p)
            for p in ("p80", "p90", "p95")
        ]
    )
    return curve.join(marks, list(by))
