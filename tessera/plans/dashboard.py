"""Precomputed dashboard: build the tables once, then answer views from them.

Tables are laid out for one metro and year at a time: places are in one directory per
year and sorted by metro inside the files, so a view's filters prune directories and
row groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.keys import exclude_regions, level_key, outside
from tessera.operators.clusters import cluster_profile, expand_definitions
from tessera.operators.lookup import top_metros
from tessera.operators.summaries import metro_shares, metro_summary, metro_thresholds
from tessera.plans import views
from tessera.sources.staging import stage

PLACE_COLUMNS = (
    "tract", "job_tot", "ALAND_SQMI", "density", "cbsa", "cbsa_name", "metro_total", *fv.CUT_COLUMNS,
)


def build(
    categories: DataFrame,
    crosswalk: DataFrame,
    bounds: DataFrame,
    centres: DataFrame,
    folder: str,
    minimums: Sequence[float] = tuple(fv.MINIMUM_SHARES),
    excluded_states: Sequence[str] = fv.EXCLUDED_STATES,
    excluded_metros: Sequence[str] = fv.EXCLUDED_METROS_DASHBOARD,
    widths: Mapping[str, int] = fv.KEY_LEVELS,
) -> None:
    """Write the tables of a dashboard below ``folder``.

    Summaries and cut-points are computed before the excluded states are removed, and
    the excluded metros are left out of the metro list only.
    """
    places = stage(categories.select("year", *PLACE_COLUMNS), "categories")

    shown = exclude_regions(places, "tract", excluded_states, widths=widths)
    shown.hint("rebalance", "year").sortWithinPartitions("year", "cbsa_name").write.mode("overwrite").partitionBy(
        "year"
    ).parquet(f"{folder}/places")

    metros = top_metros(crosswalk)
    profile = cluster_profile(places.filter("cbsa IS NOT NULL"), ["cbsa", "year"], ["job_tot"], minimums)
    shares = metro_shares(metro_summary(expand_definitions(profile, minimums), metros))
    shares.write.mode("overwrite").parquet(f"{folder}/metro_shares")

    metro_thresholds(places, crosswalk).write.mode("overwrite").parquet(f"{folder}/thresholds")

    counties = crosswalk.filter("top100 = 1").select("stcofips", "cbsa_name")
    placed = bounds.withColumn("stcofips", level_key(F.col("geoid"), "county", widths)).join(counties, "stcofips")
    placed.drop("stcofips").hint("rebalance").sortWithinPartitions("cbsa_name").write.mode(
        "overwrite"
    ).parquet(f"{folder}/bounds")

    listed = metros.filter(outside(F.col("cbsa"), excluded_metros))
    listed.join(centres.select("cbsa", "lat", "lon"), "cbsa", "left").write.mode("overwrite").parquet(
        f"{folder}/metros"
    )


class Dashboard:
    """Views over the tables that ``build`` wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def metros(self) -> DataFrame:
        return self.table("metros")

    def cluster_view(self, cbsa_name: str, year: int, choice: int, minimum: float) -> DataFrame:
        bounds = self.table("bounds").filter(F.col("cbsa_name") == cbsa_name).drop("cbsa_name")
        return views.cluster_view(self.table("places"), bounds, cbsa_name, year, choice, minimum)

    def overview(self, cbsa_name: str, year: int) -> DataFrame:
        return views.overview_table(self.table("metro_shares"), cbsa_name, year)

    def describe(self, cbsa_name: str, year: int) -> DataFrame:
        return views.describe_metro(self.table("metro_shares"), self.metros(), cbsa_name, year)

    def distribution(self, cbsa_name: str, year: int) -> DataFrame:
        one = (F.col("cbsa_name") == cbsa_name) & (F.col("year") == year)
        return views.distribution_view(self.table("places").filter(one), self.table("thresholds").filter(one))
