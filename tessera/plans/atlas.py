"""The shared first steps of the analyses over one data directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Params
from tessera.functions.keys import exclude_regions
from tessera.operators.clusters import cluster_profile, expand_definitions, map_categories
from tessera.operators.density import compute_density, density_tiles
from tessera.operators.joins import attach, members
from tessera.operators.lookup import metro_counties, top_metros
from tessera.operators.ranking import keep_rows
from tessera.operators.rollup import rollup
from tessera.operators.stats import job_places
from tessera.operators.summaries import metro_shares, metro_summary
from tessera.sources.staging import stage
from tessera.sources.star import TYPE_SECTORS, Star

SECTORS = tuple(TYPE_SECTORS.values())
Years = Sequence[int] | None


class Atlas:
    """Lazy tables from block counts to cluster profiles."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params):
        self.star = Star(spark, sf_dir)
        self.params = params

    def metros(self) -> DataFrame:
        return metro_counties(self.star.crosswalk()).select(
            "stcofips", "cbsa", "cbsa_name", "top100"
        )

    def counties(self, metro: str | None) -> DataFrame | None:
        """Counties of one metro, named as in the crosswalk; None for all places."""
        return self.metros().filter(F.col("cbsa_name") == metro).select("stcofips") if metro else None

    def lehd(
        self, years: Years = None, measures: Sequence[str] | None = None, only: str | None = None
    ) -> DataFrame:
        """Counts by tract and year with land area; ``only`` keeps the places of one metro.

        Ranks are taken inside metro and year, so both limits hold before anything is
        summed or ranked.
        """
        counts = self.star.wac(years, self.counties(only), measures)
        tracts = rollup(counts, "fips", "tract", ["year"], measures, widths=self.params.key_levels)
        return attach(tracts, self.star.area(), "tract")

    def density(
        self, carry: Sequence[str] = (), years: Years = None, metro: Sequence[str] = ("cbsa", "cbsa_name"),
        only: str | None = None,
    ) -> DataFrame:
        lehd = self.lehd(years, ["job_tot", *carry], only)
        widths = self.params.key_levels
        return compute_density(lehd, "job_tot", self.metros(), carry=carry, metro=metro, widths=widths)

    def staged_density(
        self, carry: Sequence[str] = (), years: Years = None, metro: Sequence[str] = ("cbsa", "cbsa_name"),
        only: str | None = None,
    ) -> DataFrame:
        """Densities kept once, unsorted: selection reads them more than once, and lines cost far more than places."""
        return keep_rows(self.density(carry, years, metro, only), "density")

    def top_density(self) -> DataFrame:
        """Densities of the top metros only."""
        top = top_metros(self.metros()).select("cbsa")
        return members(self.density(), "cbsa", top)

    def categories(
        self, carry: Sequence[str] = (), years: Years = None, metro: Sequence[str] = ("cbsa", "cbsa_name"),
        only: str | None = None,
    ) -> DataFrame:
        dense = self.staged_density(carry, years, metro, only)
        return map_categories(density_tiles(dense, metro_total="job_tot"))

    def defined(
        self, keys: Sequence[str], minimums: Sequence[float], years: Years = None, only: str | None = None
    ) -> DataFrame:
        """Expanded cluster profile, excluded states removed after the tiling."""
        kept = exclude_regions(
            self.categories(years=years, metro=("cbsa", "cbsa_name", "top100"), only=only),
            "tract",
            self.params.excluded_states,
            widths=self.params.key_levels,
        )
        return expand_definitions(cluster_profile(kept, keys, ["job_tot"], minimums), minimums)

    def sector_profile(self, minimums: Sequence[float], years: Years = None) -> DataFrame:
        kept = exclude_regions(
            self.categories(SECTORS, years), "tract", self.params.excluded_states, widths=self.params.key_levels
        )
        return cluster_profile(kept, ["year"], ["job_tot", *SECTORS], minimums)

    def top_metros(self) -> DataFrame:
        return top_metros(self.metros(), self.params.excluded_metros)

    def metro_summary(self, years: Years = None, only: str | None = None) -> DataFrame:
        defined = self.defined(["cbsa", "year"], self.params.minimums, years, only)
        return metro_summary(defined, self.top_metros())

    def metro_shares(self, years: Years = None, only: str | None = None) -> DataFrame:
        return metro_shares(self.metro_summary(years, only))

    def places(self) -> DataFrame:
        """Job places, staged: the statistics pass over them more than once."""
        return stage(job_places(self.lehd(measures=["job_tot"]), self.params.key_levels), "places")
