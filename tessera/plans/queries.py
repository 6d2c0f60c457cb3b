"""Named queries: one per operator, each over whole tables of a data directory.

The directory stands in for the real inputs: see :mod:`tessera.sources.star`.
Region ``04`` plays the excluded states and ``M2`` the excluded metro, and the
two periods compared are 1996 and 1997.  Ratios that depend on the order of
floating-point sums are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as fv
from tessera.config import Params
from tessera.functions import columns as cols
from tessera.functions import keys, sectors
from tessera.operators import (
    clusters,
    density,
    geo,
    industry,
    joins,
    lookup,
    partials,
    reconcile,
    reshape,
    rollup,
    selection,
    stats,
    summaries,
)
from tessera.plans import dashboard, views
from tessera.plans.atlas import SECTORS, Atlas
from tessera.sources import files, kept, layouts, staging
from tessera.sources.star import ALL_YEARS, COUNTY, LEVELS, TABLES

YEARS = (1996, 1997)
PARAMS = Params(excluded_states=("04",), excluded_metros=("M2",), years=YEARS, key_levels=LEVELS)
METRO = "City1-Town, R1"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Atlas], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Atlas(spark, sf_dir, PARAMS))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round doubles (all, or the named ones) and turn -0.0 into 0.0."""

    def value(field) -> str:
        if isinstance(field.dataType, T.DoubleType) and (not names or field.name in names):
            return f"round(`{field.name}`, {places}) + 0D AS `{field.name}`"
        return f"`{field.name}`"

    return df.selectExpr(*[value(f) for f in df.schema.fields])


# --- sources and sinks -------------------------------------------------------


@query
def scan_area_tsv(a: Atlas) -> DataFrame:
    path = staging.new_path(a.star.spark, "area-tsv")
    # As published: the wanted columns stand among others.
    wide = a.star.area().selectExpr(
        "substring(tract, 1, 2) AS USPS", "tract AS GEOID", "ALAND_SQMI * 2589988.11 AS ALAND", "0D AS AWATER",
        "ALAND_SQMI", "0D AS AWATER_SQMI", "CAST(NULL AS STRING) AS INTPTLAT",
    )
    wide.write.option("sep", "\t").option("header", True).csv(path)
    return files.read_area(a.star.spark, path)


@query
def stage_roundtrip(a: Atlas) -> DataFrame:
    path = staging.new_path(a.star.spark, "lehd")
    lehd = a.lehd()
    staging.save_stage(lehd, path)
    return staging.load_stage(a.star.spark, path, lehd.schema)


@query
def scan_problems(a: Atlas) -> DataFrame:
    """Bad cells of a delimited scan by column and text, beside the number of rows read."""
    path = staging.new_path(a.star.spark, "problem-tsv")
    bad = a.star.area().selectExpr(
        "tract AS GEOID", "CASE WHEN tract LIKE '%7' THEN 'n/a' ELSE CAST(ALAND_SQMI AS STRING) END AS ALAND_SQMI",
        "CASE WHEN tract LIKE '%3' THEN 'twelve' ELSE '12' END AS BLOCKS",
    )
    bad.write.option("sep", "\t").option("header", True).csv(path)
    rows, problems = files.scan_tsv(
        a.star.spark, path, T.StructType.fromDDL("GEOID string, ALAND_SQMI double, BLOCKS int")
    )
    summed = problems.groupBy("column", "expected", "raw").agg(F.count("*").alias("cells"), F.countDistinct("file", "row").alias("rows_hit"))
    counts = rows.agg(F.count("*").alias("rows_read"), F.count("ALAND_SQMI").alias("areas"), F.count("BLOCKS").alias("blocks"))
    whole = summed.withColumn("_whole", counts.select(F.struct("rows_read", "areas", "blocks")).scalar())
    return whole.select("column", "expected", "raw", "cells", "rows_hit", "_whole.*")


@query
def refresh_period(a: Atlas) -> DataFrame:
    """A kept stage of tiles after one year was added and another one revised: only these are ranked again."""
    spark = a.star.spark
    raw, path = staging.new_path(spark, "raw"), staging.new_path(spark, "kept-tiles")
    counts = staging.stage(a.lehd(measures=["job_tot"]), "counts")
    staging.save_stage(counts.filter(F.col("year") < ALL_YEARS[-1]), raw)

    def tiles(years: list) -> DataFrame:
        some = staging.load_stage(spark, raw, counts.schema).filter(F.col("year").isin(*years))
        dense = density.compute_density(some, "job_tot", a.metros(), widths=LEVELS)
        return density.density_tiles(dense, tiles=(20,)).select("tract", "job_tot", "density", "cbsa", "dense_cat_20", "year")

    def versions(years) -> dict:
        return {y: kept.files_version(spark, f"{raw}/year={y}") for y in years}

    tiled = kept.KeptStage(spark, path)
    tiled.refresh(versions(ALL_YEARS[:-1]), tiles)
    revised = F.expr("CASE WHEN year = 1997 AND job_tot % 2 = 1 THEN job_tot * 2 ELSE job_tot END")
    changed = counts.withColumn("job_tot", revised).filter(F.col("year").isin(1997, ALL_YEARS[-1]))
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(raw)
    rebuilt = tiled.refresh(versions(ALL_YEARS), tiles)
    schema = T.StructType.fromDDL("tract string, job_tot bigint, density double, cbsa string, dense_cat_20 int, year int")
    return tiled.read(schema).withColumn("rebuilt", F.col("year").isin(*rebuilt))


@query
def export_csv(a: Atlas) -> DataFrame:
    path = staging.new_path(a.star.spark, "lehd-csv")
    lehd = a.lehd(measures=["job_tot"]).select("tract", "year", "job_tot", "ALAND_SQMI")
    files.export_csv(lehd, path)
    return a.star.spark.read.schema(lehd.schema).option("header", True).csv(path)


@query
def stack_periods(a: Atlas) -> DataFrame:
    # One kept part per year; the early ones have no sector.
    path = staging.new_path(a.star.spark, "periods")
    kept = a.lehd(measures=["job_tot", "naics_92"]).select("tract", "year", "job_tot", "naics_92")
    staging.save_stage(kept, path)
    parts = {}
    for year in ALL_YEARS:
        part = staging.load_stage(a.star.spark, path, kept.schema).filter(F.col("year") == year).drop("year")
        parts[year] = part.drop("naics_92") if year < YEARS[0] else part
    return files.stack_periods(parts)


# --- keys, projections, recodes, filters --------------------------------------


@query
def pad_code(a: Atlas) -> DataFrame:
    codes = a.star.table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    return keys.with_padded(codes, "code").withColumn(
        "code3", keys.pad_code(F.col("c_custkey").cast("string"), 3)
    )


@query
def key_levels(a: Atlas) -> DataFrame:
    blocks = rollup.grouped_totals(a.star.wac(measures=["job_tot"]), ["fips", "year"], job_tot="job_tot")
    return keys.with_levels(blocks, "fips", widths=LEVELS)


@query
def remap_codes(a: Atlas) -> DataFrame:
    retired = (
        a.star.area()
        .filter(keys.level_key(F.col("tract"), "county", LEVELS) == "04024")
        .select(
            F.col("tract").alias("old"),
            F.concat(F.lit("04019"), F.substring("tract", 6, 18), F.lit("0")).alias("new"),
        )
    )
    # Tracts are summed before and after, so the join meets one row per tract and year.
    counts = rollup.rollup(a.star.wac(measures=["job_tot"]), "fips", "tract", ["year"], ["job_tot"], widths=LEVELS)
    return rollup.rollup(lookup.remap_codes(counts, "tract", retired), "tract", "tract", widths=LEVELS)


@query
def remap_chain(a: Atlas) -> DataFrame:
    """Retired codes in chains, a merge and a split: whole counts are divided without loss."""
    tracts = a.star.area().select("tract")
    chained = tracts.filter(keys.level_key(F.col("tract"), "county", LEVELS) == "04024")
    merged = tracts.filter(keys.level_key(F.col("tract"), "county", LEVELS) == "04014")
    hops = chained.selectExpr(
        "inline(array(named_struct('old', tract, 'new', concat(tract, 'a'), 'weight', 1L),"
        " named_struct('old', concat(tract, 'a'), 'new', concat(tract, 'b'), 'weight', 1L),"
        " named_struct('old', concat(tract, 'b'), 'new', concat('04019', substring(tract, 6, 19), '1'), 'weight', 1L),"
        " named_struct('old', concat(tract, 'b'), 'new', concat('04019', substring(tract, 6, 19), '2'), 'weight', 2L)))"
    ).unionByName(merged.selectExpr("tract AS old", "'04009' AS new", "5L AS weight"))
    counts = rollup.rollup(a.star.wac(measures=["job_tot"]), "fips", "tract", ["year"], ["job_tot"], widths=LEVELS)
    split = lookup.split_codes(counts, "tract", hops, ["job_tot"])
    return split.groupBy("tract", "year").agg(cols.total("job_tot").alias("job_tot"))


@query
def compose_key(a: Atlas) -> DataFrame:
    orders = a.star.table("orders").select("o_orderkey", "o_custkey")
    blocks = a.star.located(orders, "o_custkey").selectExpr(
        "o_orderkey", f"{COUNTY} AS county", "o_custkey / 100D AS tract", "o_orderkey AS block"
    )
    return keys.compose_block_key(blocks, "county", "tract", "block").select("o_orderkey", "fips")


def national_sectors(a: Atlas) -> DataFrame:
    """Sums by sector over all places and years: summed wide, then long."""
    sums = a.star.wac().agg(*[cols.total(s).alias(s) for s in SECTORS])
    return reshape.to_long(sums, [], SECTORS, "naics", "jobs")


@query
def sector_label(a: Atlas) -> DataFrame:
    return sectors.sector_label(national_sectors(a), new_column=True)


@query
def harmonise_sector(a: Atlas) -> DataFrame:
    return national_sectors(a).withColumn("harmonised", sectors.harmonise_sector(F.col("naics")))


@query
def split_id(a: Atlas) -> DataFrame:
    split = sectors.split_id(a.star.emp(), "DBcode")
    return cols.prefix_numbered(split, 1970, 2016)


@query
def select_family(a: Atlas) -> DataFrame:
    renamed = cols.prefix_numbered(a.star.emp(), 1970, 2016)
    chosen = cols.select_family(renamed, first=["stcofips", "DBcode"], numbered=("y", 1997, 2016))
    return cols.clean_names(chosen)


@query
def short_name(a: Atlas) -> DataFrame:
    return (
        a.star.crosswalk()
        .select("stcofips", "cbsa_name")
        .withColumn("short_name", keys.short_name(F.col("cbsa_name")))
    )


@query
def xwalk_subset(a: Atlas) -> DataFrame:
    return lookup.top_metros(a.metros())


@query
def exclude_regions(a: Atlas) -> DataFrame:
    dense = a.density().select("tract", "year", "cbsa", "job_tot")
    return keys.exclude_regions(dense, "tract", PARAMS.excluded_states, PARAMS.excluded_metros, widths=LEVELS)


@query
def universe_filter(a: Atlas) -> DataFrame:
    return keys.universe_filter(a.star.area(), "tract", renamed="geoid", widths=LEVELS)


@query
def coords_backfill(a: Atlas) -> DataFrame:
    centres = a.star.centres()
    found = centres.select("cbsa", F.lit(41.5).alias("lat"), F.lit(-71.25).alias("lon"))
    by_hand = centres.filter(F.col("cbsa") == "M2").select(
        "cbsa", F.lit(29.5).alias("lat"), F.lit(-98.5).alias("lon")
    )
    return lookup.coords_backfill(centres, found, by_hand)


# --- joins --------------------------------------------------------------------


@query
def join_area_metro(a: Atlas) -> DataFrame:
    lehd = a.lehd(measures=["job_tot"]).withColumn("stcofips", keys.level_key(F.col("tract"), "county", LEVELS))
    return joins.attach(lehd, a.metros().select("stcofips", "cbsa", "cbsa_name"), "stcofips")


@query
def join_nullsafe(a: Atlas) -> DataFrame:
    dense = staging.stage(a.density().select("tract", "year", "cbsa", "job_tot"), "density")
    metro_jobs = rollup.grouped_totals(dense, ["cbsa", "year"], metro_jobs="job_tot")
    return joins.join_summary(dense, metro_jobs, ["cbsa", "year"])


@query
def merge_periods(a: Atlas) -> DataFrame:
    counties = rollup.rollup(a.star.wac(YEARS, measures=["job_tot"]), "fips", "county", ["year"], ["job_tot"], widths=LEVELS)
    snapshots = staging.stage(counties, "counties")
    first, second = (snapshots.filter(F.col("year") == y).drop("year") for y in YEARS)
    return joins.merge_periods(first, second, ["county"], ("_1996", "_1997"))


@query
def thresholds_full_join(a: Atlas) -> DataFrame:
    cuts = staging.stage(summaries.metro_thresholds(a.staged_density(years=YEARS), a.metros()), "thresholds")
    first, second = (cuts.filter(F.col("year") == y).drop("year") for y in YEARS)
    return rounded(
        joins.merge_periods(
            first, second, ["cbsa", "cbsa_name", "percentile"], ("_1996", "_1997"), how="full"
        )
    )


@query
def geo_attribute_join(a: Atlas) -> DataFrame:
    layer = geo.geo_attribute_join(a.categories(), a.star.bounds())
    return layer.select(
        "geoid",
        "tract",
        "job_tot",
        "density",
        "ALAND_SQMI",
        *[f"dense_cat_{n}" for n in fv.TILE_COUNTS],
        *[f"most_dense_{n}" for n in fv.TILE_COUNTS],
        *fv.CUT_COLUMNS,
        F.col("rings")[0][0]["lon"].alias("west"),
        F.col("rings")[0][2]["lat"].alias("north"),
    )


@query
def select_group_units(a: Atlas) -> DataFrame:
    return geo.select_group_units(a.lehd(measures=["job_tot"]), "M1", lookup.top_counties(a.metros()), widths=LEVELS)


@query
def anti_dense(a: Atlas) -> DataFrame:
    places = a.places()
    return stats.ordinary_places(places, a.metros(), stats.most_dense(places)).select(
        "tract", "year", "cbsa_name", "jobs_sqmi"
    )


# --- aggregations ---------------------------------------------------------------


@query
def rollup_tract(a: Atlas) -> DataFrame:
    return a.lehd()


@query
def rollup_county(a: Atlas) -> DataFrame:
    return rollup.rollup(a.star.wac(), "fips", "county", out="stcofips", widths=LEVELS)


@query
def rollup_state_density(a: Atlas) -> DataFrame:
    return rollup.level_density(a.lehd(measures=["job_tot"]), "tract", "state", "job_tot", "ALAND_SQMI", widths=LEVELS)


@query
def rollup_county_density(a: Atlas) -> DataFrame:
    return rollup.level_density(a.lehd(measures=["job_tot"]), "tract", "county", "job_tot", "ALAND_SQMI", widths=LEVELS)


@query
def rollup_buckets(a: Atlas) -> DataFrame:
    """Tract sums with land area from block counts and areas kept in buckets of the tract key."""
    spark, buckets = a.star.spark, int(a.star.spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = a.star.wac(measures=["job_tot"]).withColumn("tract", keys.level_key(F.col("fips"), "tract", LEVELS))
    tables = {"counts": blocks, "areas": a.star.area()}
    names, found = {}, {}
    for label, table in tables.items():
        path = staging.new_path(spark, f"buckets-{label}")
        names[label] = "tessera_" + path.rsplit("/", 1)[1].replace("-", "_")
        found[label] = layouts.save_buckets(table, names[label], path, "tract", buckets)
    sums = found["counts"].groupBy("tract", "year").agg(cols.total("job_tot").alias("job_tot"))
    return sums.join(found["areas"], "tract", "left")


@query
def moments_by_state(a: Atlas) -> DataFrame:
    """Mean, spread, correlation and line per state and year, from moments kept per county and year."""
    places = job_places_once(a)
    fine = staging.stage(partials.partial_moments(places, ["stfips", "stcofips", "year"], "ALAND_SQMI", "job_tot"), "moments")
    by = ["stfips", "year"]
    return rounded(partials.describe_moments(partials.merge_moments(fine, by), by))


@query
def distinct_over_years(a: Atlas) -> DataFrame:
    """Different tracts with jobs per metro over one year, two and all, from unit sets kept per year."""
    dense = a.staged_density().filter("job_tot > 0")
    sets = staging.stage(partials.unit_sets(dense, "tract", partials.number_units(dense, "tract"), ["cbsa", "year"]), "unit-sets")
    spans = {"one": (1997,), "two": YEARS, "all": ALL_YEARS}
    counted = [
        partials.count_units(sets.filter(F.col("year").isin(*years)), ["cbsa"], "tracts").withColumn("span", F.lit(name))
        for name, years in spans.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def national_totals(a: Atlas) -> DataFrame:
    kept = keys.exclude_regions(a.star.wac(measures=["job_tot"]), "fips", PARAMS.excluded_states, widths=LEVELS)
    return rollup.grouped_totals(kept, ["year"], natl_job_tot="job_tot")


@query
def top_metro_totals(a: Atlas) -> DataFrame:
    kept = keys.exclude_regions(a.star.wac(measures=["job_tot"]), "fips", PARAMS.excluded_states, widths=LEVELS)
    return rollup.member_totals(
        kept, "fips", lookup.top_counties(a.metros()), ["year"], LEVELS, natl_job_tot="job_tot"
    )


@query
def dense_share(a: Atlas) -> DataFrame:
    return rounded(stats.dense_share(a.places(), "job_tot", "jobs_sqmi"))


@query
def tile_shares(a: Atlas) -> DataFrame:
    flags = {f"top_{n}": f"most_dense_{n}" for n in fv.TILE_COUNTS}
    return rounded(rollup.flagged_share(density.density_tiles(a.staged_density()), "job_tot", ["year"], **flags))


def job_places_once(a: Atlas) -> DataFrame:
    """Job places for a single pass."""
    return stats.job_places(a.lehd(measures=["job_tot"]), LEVELS)


@query
def dense_coverage(a: Atlas) -> DataFrame:
    return stats.dense_coverage(stats.most_dense(a.places()), a.metros())


@query
def metro_medians(a: Atlas) -> DataFrame:
    places = a.places()
    return rounded(stats.metro_medians(places, a.metros(), stats.most_dense(places)))


@query
def metro_thresholds(a: Atlas) -> DataFrame:
    return rounded(summaries.metro_thresholds(a.staged_density(), a.metros()))


@query
def six_number_summary(a: Atlas) -> DataFrame:
    return rounded(
        stats.six_number_summary(a.places(), ["job_tot", "jobs_sqmi"], ["tract"], ["year"])
    )


@query
def flag_counts(a: Atlas) -> DataFrame:
    return stats.flag_counts(density.density_tiles(a.staged_density()), "most_dense_20", ["year"])


@query
def freq_table(a: Atlas) -> DataFrame:
    dense = stats.most_dense(a.places())
    named = joins.attach(dense, a.metros().select("stcofips", "cbsa_name"), "stcofips")
    return stats.freq_table(named, "cbsa_name", ["year"])


@query
def argmax_area(a: Atlas) -> DataFrame:
    pop = pop_places(a)
    return stats.argmax(pop, ["stcofips"], "pop", "tract", ["ALAND_SQMI"])


@query
def industry_totals(a: Atlas) -> DataFrame:
    return rounded(industry.industry_totals(a.lehd(YEARS), YEARS, PARAMS.excluded_states, widths=LEVELS))


@query
def density_corr(a: Atlas) -> DataFrame:
    pop = pop_places(a)
    return rounded(stats.density_corr(job_places_once(a), pop))


# --- windows ----------------------------------------------------------------------


@query
def density_tiles(a: Atlas) -> DataFrame:
    return density.density_tiles(a.staged_density())


@query
def top_percentiles(a: Atlas) -> DataFrame:
    return stats.most_dense(a.places())


# --- reshape and sort ----------------------------------------------------------------


@query
def unpivot_sectors(a: Atlas) -> DataFrame:
    return industry.industry_long(a.lehd(), PARAMS.excluded_states, widths=LEVELS)


@query
def pivot_years(a: Atlas) -> DataFrame:
    by_county = rollup.rollup(a.star.wac(measures=["job_tot"]), "fips", "county", ["year"], ["job_tot"], widths=LEVELS)
    return reshape.to_wide(by_county, ["county"], "year", "job_tot", ALL_YEARS, prefix="year_")


@query
def overview_table(a: Atlas) -> DataFrame:
    return rounded(views.overview_table(a.metro_shares((1997,), METRO), METRO, 1997))


@query
def rank_categories(a: Atlas) -> DataFrame:
    places = job_places_once(a).filter(F.col("ALAND_SQMI") > 0)
    named = joins.attach(places, a.metros().select("stcofips", "cbsa_name"), "stcofips")
    return rounded(stats.rank_categories(named, "cbsa_name", "jobs_sqmi", ["year"]))


# --- cluster pipeline -----------------------------------------------------------------


@query
def tract_density(a: Atlas) -> DataFrame:
    return a.density()


@query
def block_density(a: Atlas) -> DataFrame:
    return block_groups(a)


@query
def block_density_metro(a: Atlas) -> DataFrame:
    return block_groups(a, "M1")


def block_groups(a: Atlas, metro: str | None = None) -> DataFrame:
    counts = a.star.wac(measures=["job_tot"])
    return density.compute_block_density(counts, a.star.block_area(), "job_tot", a.metros(), metro, widths=LEVELS)


@query
def block_categories(a: Atlas) -> DataFrame:
    tiled = density.density_tiles(staging.stage(block_groups(a), "blocks"), unit="blkgrp")
    return clusters.map_categories(tiled).select("blkgrp", "year", "cbsa", "density", *fv.CUT_COLUMNS)


@query
def block_quantiles(a: Atlas) -> DataFrame:
    blocks = staging.stage(block_groups(a).select("year", "job_tot", "density"), "blocks")
    cuts = {"p80": 0.8, "p90": 0.9, "p95": 0.95}
    return rounded(selection.select_quantiles(blocks, ["year"], ["job_tot", "density"], cuts))


@query
def map_categories(a: Atlas) -> DataFrame:
    return a.categories().select("tract", "year", "cbsa", *fv.CUT_COLUMNS)


@query
def categories_long(a: Atlas) -> DataFrame:
    return clusters.categories_long(a.categories().drop("metro_total"))


@query
def metro_minimums(a: Atlas) -> DataFrame:
    return rounded(clusters.metro_minimums(a.density()))


@query
def minimums_lookup(a: Atlas) -> DataFrame:
    return rounded(clusters.minimums_lookup(clusters.metro_minimums(a.density()), 0.5))


@query
def cluster_flags(a: Atlas) -> DataFrame:
    flagged = clusters.cluster_flags(clusters.categories_long(a.categories()), PARAMS.minimums)
    return rounded(
        flagged.select("tract", "year", "cbsa", "job_tot", "num_quant", "pp_min", "job_min", "mapvar")
    )


@query
def metro_summary(a: Atlas) -> DataFrame:
    return a.metro_summary()


@query
def metro_summary_all(a: Atlas) -> DataFrame:
    """The dashboard's form: no place and no metro is left out."""
    profile = clusters.cluster_profile(
        a.categories().filter("cbsa IS NOT NULL"), ["cbsa", "year"], ["job_tot"], PARAMS.minimums
    )
    defined = clusters.expand_definitions(profile, PARAMS.minimums)
    return summaries.metro_summary(defined, lookup.top_metros(a.metros()))


@query
def metro_shares(a: Atlas) -> DataFrame:
    return rounded(a.metro_shares())


@query
def metro_two_year(a: Atlas) -> DataFrame:
    return rounded(
        summaries.two_periods(
            a.metro_shares(YEARS), ["cbsa", "cbsa_name", "num_quant", "min"], YEARS, ("_1996", "_1997")
        )
    )


@query
def national_clusters(a: Atlas) -> DataFrame:
    return rounded(summaries.national_clusters(a.defined(["year"], PARAMS.minimums)))


@query
def national_clusters_restricted(a: Atlas) -> DataFrame:
    """Jobs in clusters of top metros over all their jobs: the consistent form."""
    found = a.defined(["year", "top100"], PARAMS.minimums)
    return rounded(summaries.national_clusters(found, "top100 = 1", restrict_numerator=True))


@query
def national_two_year(a: Atlas) -> DataFrame:
    found = summaries.national_clusters(a.defined(["year"], PARAMS.minimums, YEARS))
    return rounded(
        summaries.two_periods(found, ["Density", "Minimum job share"], YEARS, (" 1996", " 1997"))
    )


@query
def national_two_year_topmetro(a: Atlas) -> DataFrame:
    found = summaries.national_clusters(
        a.defined(["year", "top100"], PARAMS.minimums, YEARS), "top100 = 1"
    )
    return rounded(
        summaries.two_periods(found, ["Density", "Minimum job share"], YEARS, (" 1996", " 1997"))
    )


# --- industry ---------------------------------------------------------------------------


@query
def industry_cluster_shares(a: Atlas) -> DataFrame:
    profile = a.sector_profile(PARAMS.minimums, YEARS)
    return rounded(industry.industry_cluster_shares(profile, YEARS, PARAMS.minimums))


@query
def location_quotient(a: Atlas) -> DataFrame:
    profile = staging.stage(a.sector_profile(PARAMS.minimums, YEARS), "profile")
    shares = industry.industry_cluster_shares(profile, YEARS, PARAMS.minimums)
    # The profile holds every place once, so it gives the national totals as well.
    totals = industry.sector_totals(profile, YEARS, (), widths=LEVELS)
    return rounded(industry.location_quotient(shares, totals, YEARS))


# --- two-source reconciliation -----------------------------------------------------------


def both_sources(
    a: Atlas, year: int, measures: tuple[str, ...] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    counties = reconcile.county_counts(a.star.wac((year,), measures=measures), LEVELS)
    totals, by_sector = reconcile.prepare_second_source(a.star.emp((year,)), year, year)
    return counties, totals, by_sector


@query
def recon_prepare(a: Atlas) -> DataFrame:
    totals, by_sector = reconcile.prepare_second_source(staging.stage(a.star.emp(), "emp"), ALL_YEARS[0], ALL_YEARS[-1])
    whole = totals.withColumnRenamed("industry", "naics")
    return rounded(by_sector.unionByName(whole))


@query
def recon_county(a: Atlas) -> DataFrame:
    counties, totals, _ = both_sources(a, 1997, ("job_tot",))
    return rounded(reconcile.county_check(counties, totals, 1997))


@query
def recon_overall(a: Atlas) -> DataFrame:
    counties, totals, _ = both_sources(a, 1997, ("job_tot",))
    return rounded(reconcile.overall_check(reconcile.county_check(counties, totals, 1997)))


@query
def recon_sector(a: Atlas) -> DataFrame:
    counties, _, by_sector = both_sources(a, 1997)
    return rounded(reconcile.sector_check(counties, by_sector, 1997))


@query
def recon_metro(a: Atlas) -> DataFrame:
    counties, totals, _ = both_sources(a, 1997, ("job_tot",))
    return rounded(reconcile.metro_check(counties, totals, a.metros(), 1997))


@query
def recon_metro_sector(a: Atlas) -> DataFrame:
    counties, _, by_sector = both_sources(a, 1997)
    return rounded(reconcile.metro_sector_check(counties, by_sector, a.metros(), 1997))


@query
def recon_metro_sector_unguarded(a: Atlas) -> DataFrame:
    counties, _, by_sector = both_sources(a, 1997)
    return rounded(reconcile.metro_sector_check(counties, by_sector, a.metros(), 1997, guarded=False))


@query
def recon_wide_gap(a: Atlas) -> DataFrame:
    counties, totals, _ = both_sources(a, 1997, ("job_tot",))
    counties, totals = staging.stage(counties, "counties"), staging.stage(totals, "totals")
    national = reconcile.overall_check(reconcile.county_check(counties, totals, 1997))
    metros = reconcile.metro_check(counties, totals, a.metros(), 1997)
    flagged = reconcile.wide_gap(metros, national.select("percent_delta").scalar())
    five = F.abs(F.col("percent_delta")) > fv.WIDE_GAP
    return rounded(
        flagged.select("cbsa", "cbsa_name", "percent_delta", "wide_gap", five.alias("over_limit"))
    )


@query
def recon_long(a: Atlas) -> DataFrame:
    counties, _, by_sector = both_sources(a, 1997)
    return rounded(reconcile.side_by_side(reconcile.sector_check(counties, by_sector, 1997)))


@query
def recon_histogram(a: Atlas) -> DataFrame:
    counties, totals, _ = both_sources(a, 1997, ("job_tot",))
    check = staging.stage(reconcile.county_check(counties, totals, 1997), "check")
    return rounded(stats.histogram(check, "percent_delta", []))


@query
def recon_delta_summary(a: Atlas) -> DataFrame:
    counties, _, by_sector = both_sources(a, 1997)
    check = reconcile.metro_sector_check(counties, by_sector, a.metros(), 1997)
    reliable = F.when(~F.col("naics").isin(*fv.UNRELIABLE_SECTORS), F.col("percent_delta"))
    measured = staging.stage(
        check.select("cbsa", "naics", reliable.alias("percent_delta"), "delta_share"), "deltas"
    )
    return rounded(stats.six_number_summary(measured, ["percent_delta", "delta_share"], ["cbsa", "naics"]))


# --- descriptive statistics ------------------------------------------------------------------


@query
def pop_density(a: Atlas) -> DataFrame:
    return pop_places(a)


@query
def histogram(a: Atlas) -> DataFrame:
    return rounded(stats.histogram(a.places(), "jobs_sqmi", ["year"]))


@query
def freq_polygon(a: Atlas) -> DataFrame:
    return rounded(stats.freq_polygon(a.places(), "ALAND_SQMI", ["year"]))


@query
def density_curve(a: Atlas) -> DataFrame:
    dense = staging.stage(a.top_density(), "density")  # the curve is drawn for these only
    thresholds = summaries.metro_thresholds(dense, a.metros())
    return rounded(views.distribution_view(dense, thresholds), places=8)


@query
def box_stats(a: Atlas) -> DataFrame:
    places = a.places()
    usual = stats.ordinary_places(places, a.metros(), stats.most_dense(places))
    return rounded(stats.box_stats(usual, "jobs_sqmi", ["cbsa_name", "year"], ["tract"]))


@query
def linear_fit(a: Atlas) -> DataFrame:
    return rounded(stats.linear_fit(job_places_once(a), "job_tot", "ALAND_SQMI", ["year"]))


def pop_places(a: Atlas) -> DataFrame:
    return stats.pop_density(a.star.population(), a.star.area(), a.metros(), LEVELS)


@query
def pop_dense_share(a: Atlas) -> DataFrame:
    return rounded(stats.dense_share(staging.stage(pop_places(a), "places"), "pop", "pop_sqmi", []))


@query
def pop_linear_fit(a: Atlas) -> DataFrame:
    return rounded(stats.linear_fit(pop_places(a), "pop", "ALAND_SQMI"))


@query
def stack_fill(a: Atlas) -> DataFrame:
    counties, _, by_sector = both_sources(a, 1997)
    metros = staging.stage(
        reconcile.metro_sector_check(counties, by_sector, a.metros(), 1997, guarded=False), "metros"
    )
    return rounded(stats.stack_fill(metros.select("cbsa", "naics", "jobs"), ["cbsa"], "jobs"))


# --- geography ------------------------------------------------------------------------------


@query
def boundary_vertices(a: Atlas) -> DataFrame:
    return geo.boundary_vertices(a.star.bounds(), renamed="tract")


@query
def window_layer(a: Atlas) -> DataFrame:
    """Boundaries that meet a window, from a layer kept in the order of space."""
    path = staging.new_path(a.star.spark, "layer")
    layouts.save_layer(a.star.bounds(), path)
    layer = a.star.spark.read.parquet(path)
    return layouts.in_window(layer, 2.0, 100.0, 12.0, 600.0).select("geoid", "west", "south", "east", "north")


@query
def choropleth_rows(a: Atlas) -> DataFrame:
    vertices = geo.boundary_vertices(a.star.county_bounds(), renamed="stcofips")
    dense = stats.most_dense(a.places()).select("stcofips", "tract", "year", "jobs_sqmi")
    return geo.choropleth_rows(vertices, dense)


# --- dashboard views --------------------------------------------------------------------------


@query
def cluster_view(a: Atlas) -> DataFrame:
    kept = keys.exclude_regions(a.categories(years=(1997,), only=METRO), "tract", PARAMS.excluded_states, widths=LEVELS)
    return corners(views.cluster_view(kept, a.star.bounds(), METRO, 1997, 2, 0.25))


def corners(layer: DataFrame) -> DataFrame:
    return layer.select(
        "geoid",
        "tract",
        "job_tot",
        "density",
        "ALAND_SQMI",
        "mapvar",
        F.col("rings")[0][0]["lon"].alias("west"),
        F.col("rings")[0][2]["lat"].alias("north"),
    )


def dashboard_tables(a: Atlas) -> dashboard.Dashboard:
    """All tables of the dashboard: built when a view first asks for them, and again when the inputs change.

    They are kept beyond the query, under a name that holds the version of the input files.
    """

    def build(folder: str) -> None:
        dashboard.build(
            a.categories(), a.metros(), a.star.bounds(), a.star.centres(), folder, PARAMS.minimums,
            PARAMS.excluded_states, PARAMS.excluded_metros, LEVELS,
        )

    spark = a.star.spark
    version = kept.files_version(spark, *[f"{a.star.sf_dir}/{name}.parquet" for name in TABLES])
    folder = f"{staging.shared_folder(spark).rstrip('/')}/dashboard-{version}"
    return dashboard.Dashboard(spark, kept.keep_once(spark, folder, build))


@query
def dashboard_view(a: Atlas) -> DataFrame:
    return corners(dashboard_tables(a).cluster_view(METRO, 1997, 2, 0.25))


@query
def dashboard_overview(a: Atlas) -> DataFrame:
    return rounded(dashboard_tables(a).overview(METRO, 1997))


@query
def dashboard_describe(a: Atlas) -> DataFrame:
    return dashboard_tables(a).describe(METRO, 1997)


@query
def dashboard_distribution(a: Atlas) -> DataFrame:
    return rounded(dashboard_tables(a).distribution(METRO, 1997), places=8)


@query
def describe_metro(a: Atlas) -> DataFrame:
    dense = a.staged_density(years=(1997,), only=METRO)  # the metro's places of the year
    places = keys.exclude_regions(dense, "tract", PARAMS.excluded_states, widths=LEVELS)
    return views.headline(places, a.top_metros(), a.star.centres(), METRO, 1997)
