"""Categories, minimum shares, and agreement of the two ways to summarise."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.operators import clusters, density, summaries


def test_categories_for_every_tile_pair(spark):
    pairs = [(a, b) for a in (None, 1, 16, 17, 18, 19, 20) for b in (None, 8, 9, 10)]
    df = spark.createDataFrame(pairs, "dense_cat_20 int, dense_cat_10 int")
    for row in clusters.map_categories(df).collect():
        c20, c10 = row.dense_cat_20, row.dense_cat_10
        low = c20 is None or c20 < 17
        fine = "low density" if low else {17: "p80", 18: "p85"}.get(c20)
        assert row.mapvar_20 == (fine or {19: "p90", 20: "cluster"}[c20])
        assert row.mapvar_10 == (fine or ("cluster" if c10 == 10 else None))
        assert row.mapvar_5 == (None if c20 is None else "cluster" if c20 >= 17 else "low density")


def test_small_group_has_no_cluster(spark):
    df = spark.createDataFrame(
        [(f"t{i}", 2010, "m", float(i)) for i in range(10)], "tract string, year int, cbsa string, density double"
    )
    found = clusters.map_categories(density.density_tiles(df))
    assert {r.mapvar_20 for r in found.collect()} == {"low density"}


def test_area_traps(spark, rows):
    df = spark.createDataFrame(
        [("01001a", 2010, 10, 5.0), ("01001b", 2010, 3, 0.0), ("01001c", 2010, 0, 0.0), ("09009d", 2010, 2, None)],
        "tract string, year int, job_tot bigint, ALAND_SQMI double",
    )
    crosswalk = spark.createDataFrame([("01001", "m", "Metro")], "stcofips string, cbsa string, cbsa_name string")
    found = density.compute_density(df, "job_tot", crosswalk)
    assert rows(found, "tract", "density", "cbsa") == [
        ("01001a", 2.0, "m"), ("01001b", float("inf"), "m"), ("01001c", None, "m"), ("09009d", None, None),
    ]


@pytest.fixture(scope="module")
def places(spark):
    """Three metros and places without one, two years, missing densities."""
    rng = random.Random(3)
    data = []
    for i in range(900):
        for year in (2010, 2015):
            cbsa = rng.choice(["m1", "m2", "m3", None])
            jobs = rng.choice([0, 1, 5, 20, 80, 400])
            dense = None if rng.random() < 0.1 else jobs / rng.choice([1, 2, 4, 8])
            data.append((f"{i % 30:02d}{i:09d}", year, jobs, 1.0, dense, cbsa, cbsa and f"{cbsa}-x", jobs // 2))
    return spark.createDataFrame(
        data,
        "tract string, year int, job_tot bigint, ALAND_SQMI double, density double, cbsa string, "
        "cbsa_name string, naics_11 bigint",
    )


@pytest.fixture(scope="module")
def categories(places):
    return clusters.map_categories(density.density_tiles(places, metro_total="job_tot")).cache()


@pytest.fixture(scope="module")
def flags(categories):
    long = clusters.categories_long(categories)
    return clusters.cluster_flags(long, tuple(fv.MINIMUM_SHARES)).cache()


def test_long_form_has_one_row_per_cut(categories):
    long = clusters.categories_long(categories)
    assert long.count() == 3 * categories.count()
    assert not [c for c in long.columns if "dense_cat" in c or "most_dense" in c]


def test_places_without_metro_have_their_own_minimum(flags):
    lonely = flags.filter("cbsa IS NULL AND mapvar IN ('cluster', 'high density')")
    assert lonely.count() > 0
    assert lonely.filter("job_min IS NULL").count() == 0


def test_categories_partition_the_places(categories, flags):
    n = categories.count()
    counts = {(r.num_quant, r.pp_min): r["count"] for r in flags.groupBy("num_quant", "pp_min").count().collect()}
    assert counts == {(cut, share): n for cut in fv.CUT_COLUMNS for share in fv.MINIMUM_SHARES}


def test_profile_gives_the_same_sums_as_the_flags(categories, flags, rows):
    grid = tuple(fv.MINIMUM_SHARES)
    defined = clusters.expand_definitions(
        clusters.cluster_profile(categories, ["cbsa", "year"], ["job_tot", "naics_11"], grid), grid
    )
    keys = ["cbsa", "year", "num_quant", "pp_min", "mapvar"]
    sums = ["sum(job_tot) AS jobs", "sum(naics_11) AS sector"]
    short = defined.groupBy(*keys).agg(*[F.expr(s) for s in sums], F.expr("sum(_units) AS n"))
    long = flags.groupBy(*keys).agg(*[F.expr(s) for s in sums], F.expr("count(1) AS n"))
    assert rows(short) == rows(long)


def test_profile_is_small(categories):
    profile = clusters.cluster_profile(categories, ["year"], ["job_tot"], tuple(fv.MINIMUM_SHARES))
    assert profile.count() <= 2 * 7 * 6


def test_cluster_jobs_fall_with_the_minimum_and_grow_with_the_cut(flags):
    found = {
        (r.year, r.num_quant, r.pp_min): r.jobs
        for r in flags.groupBy("year", "num_quant", "pp_min")
        .agg(F.sum(F.when(F.col("mapvar") == "cluster", F.col("job_tot")).otherwise(0)).alias("jobs"))
        .collect()
    }
    shares = sorted(fv.MINIMUM_SHARES)
    for year in (2010, 2015):
        for cut in fv.CUT_COLUMNS:
            jobs = [found[year, cut, s] for s in shares]
            assert jobs == sorted(jobs, reverse=True)
        for s in shares:
            jobs = [found[year, cut, s] for cut in ("mapvar_20", "mapvar_10", "mapvar_5")]
            assert jobs == sorted(jobs)


def test_minimum_is_exclusive(spark):
    df = spark.createDataFrame(
        [("cluster", 5), ("cluster", 4), ("cluster", 6), ("p80", 9), (None, 9), ("cluster", None)],
        "c string, n bigint",
    )
    found = [r[0] for r in df.select(F.expr(clusters.apply_minimum_sql("c", "n", "5"))).collect()]
    assert found == ["high density", "high density", "cluster", "p80", None, None]


def test_minimum_lookup_and_unknown_share(categories, rows):
    met_jobs = clusters.metro_minimums(categories)
    one = clusters.minimums_lookup(met_jobs, 1, "m1", 2015).first()
    total = categories.filter("cbsa = 'm1' AND year = 2015").agg(F.sum("job_tot")).first()[0]
    assert one.job_min == total * 0.01
    assert {r.job_min for r in clusters.minimums_lookup(met_jobs, 0.33).collect()} == {0.0}


def test_metro_summary_counts(categories, flags, spark):
    grid = (0.25,)
    metros = spark.createDataFrame([("m1", "m1-x"), ("m9", "none")], "cbsa string, cbsa_name string")
    profile = clusters.cluster_profile(categories, ["cbsa", "year"], ["job_tot"], grid)
    found = summaries.metro_shares(
        summaries.metro_summary(clusters.expand_definitions(profile, grid), metros)
    ).collect()
    assert {r.cbsa for r in found} == {"m1"} and len(found) == 6
    names = {v: k for k, v in fv.METRO_CUT_NAMES.items()}
    for row in found:
        same = flags.filter(
            f"cbsa = 'm1' AND year = {row.year} AND pp_min = 0.25 AND num_quant = '{names[row.num_quant]}'"
        ).toPandas()
        inside = same[same["mapvar"] == "cluster"]
        assert row.tr_ct == len(same) and row.jobs == same["job_tot"].sum()
        assert row.cluster_ct == len(inside) and row.cluster_jobs == inside["job_tot"].sum()
        assert row.high_ct == (same["mapvar"] == "high density").sum()
        assert row.cluster_share == row.cluster_ct / row.tr_ct
        assert row.job_share == row.cluster_jobs / row.jobs * 100


def test_national_share_denominators(spark, rows):
    defined = spark.createDataFrame(
        [
            (2010, 1, "mapvar_20", 0.5, "cluster", 30, 1),
            (2010, 0, "mapvar_20", 0.5, "cluster", 10, 1),
            (2010, 1, "mapvar_20", 0.5, "low density", 70, 5),
            (2010, 0, "mapvar_20", 0.5, "low density", 90, 5),
            (2015, 1, "mapvar_20", 0.5, "low density", 90, 5),
        ],
        "year int, top100 int, num_quant string, pp_min double, mapvar string, job_tot bigint, _units bigint",
    )
    columns = ["year", "Density", "Jobs in clusters", "% of jobs in clusters"]
    whole = summaries.national_clusters(defined)
    assert rows(whole, *columns) == [(2010, "Top 5 percent", 40, 20.0)]
    top = summaries.national_clusters(defined, "top100 = 1")
    assert rows(top, *columns) == [(2010, "Top 5 percent", 40, 40.0)]
    both = summaries.national_clusters(defined, "top100 = 1", restrict_numerator=True)
    assert rows(both, *columns) == [(2010, "Top 5 percent", 30, 30.0)]


def test_two_periods_is_an_inner_join(spark, rows):
    df = spark.createDataFrame(
        [("a", 2010, 1), ("a", 2015, 2), ("b", 2010, 3), (None, 2010, 4), (None, 2015, 5)],
        "k string, year int, v int",
    )
    found = summaries.two_periods(df, ["k"], (2010, 2015), (" 2010", " 2015"))
    assert found.columns == ["k", "v 2010", "v 2015"]
    assert rows(found) == [(None, 4, 5), ("a", 1, 2)]


def test_block_density_for_one_metro(spark, rows):
    counts = spark.createDataFrame(
        [("240054001001000", 4), ("240054001001001", 6), ("240054001002000", 5), ("110010001001000", 9)],
        "fips string, job_tot bigint",
    )
    areas = spark.createDataFrame(
        [("240054001001000", 1.0), ("240054001001001", 1.5), ("110010001001000", 3.0)],
        "fips string, ALAND_SQMI double",
    )
    crosswalk = spark.createDataFrame(
        [("24005", "12580", "Baltimore"), ("11001", "47900", "Washington")],
        "stcofips string, cbsa string, cbsa_name string",
    )
    found = density.compute_block_density(counts, areas, "job_tot", crosswalk, metro="12580")
    assert rows(found, "blkgrp", "job_tot", "ALAND_SQMI", "density", "cbsa") == [
        ("240054001001", 10, 2.5, 4.0, "12580"), ("240054001002", 5, None, None, "12580"),
    ]
    everything = density.compute_block_density(counts, areas, "job_tot", crosswalk)
    assert everything.count() == 3


def test_flags_under_a_grid_without_one_percent(categories, flags):
    short = clusters.cluster_flags(clusters.categories_long(categories), (0.25, 0.5, 0.75))
    kept = flags.filter("pp_min IN (0.25, 0.5, 0.75)")
    assert short.columns == kept.columns
    assert short.exceptAll(kept).count() == 0 == kept.exceptAll(short).count()
    assert short.filter("mapvar = 'cluster'").count() > 0
