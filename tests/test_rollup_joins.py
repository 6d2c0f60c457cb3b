from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, lookup, reshape, rollup


def test_rollup_sums_every_numeric_column(spark, rows):
    df = spark.createDataFrame(
        [("0100100001a", 2010, 1, None, "x"), ("0100100001b", 2010, 2, None, "x"), ("0100200001a", 2010, None, 5.0, "y")],
        "fips string, year int, job_tot bigint, area double, note string",
    )
    found = rollup.rollup(df, "fips", "county")
    assert found.columns == ["county", "year", "job_tot", "area"]
    assert rows(found) == [("01001", 2010, 3, 0.0), ("01002", 2010, 0, 5.0)]


def test_rollup_keeps_totals_at_every_level(spark):
    df = spark.createDataFrame(
        [(f"{s:02d}{c:03d}{t:06d}{b:04d}", 2010, s + c * t + b) for s in (1, 2) for c in range(3) for t in range(4) for b in range(5)],
        "fips string, year int, jobs bigint",
    )
    whole = df.agg(F.sum("jobs")).first()[0]
    for level, places in (("state", 2), ("county", 6), ("tract", 24)):
        found = rollup.rollup(df, "fips", level)
        assert found.count() == places
        assert found.agg(F.sum("jobs")).first()[0] == whole


def test_total_row(spark, rows):
    df = spark.createDataFrame(
        [("a", "A", 1, 0.5), ("b", None, 2, None)], "naics string, label string, n bigint, share double"
    )
    assert rows(rollup.total_row(df, "naics")) == [
        ("Total", None, 3, 0.5), ("a", "A", 1, 0.5), ("b", None, 2, None),
    ]


def test_member_totals_and_flagged_share(spark, rows):
    df = spark.createDataFrame(
        [("01001a", 2010, 4, True), ("01001b", 2010, 6, False), ("01002a", 2010, 10, None)],
        "tract string, year int, jobs bigint, dense boolean",
    )
    counties = spark.createDataFrame([("01001",), ("01001",)], "stcofips string")
    assert rows(rollup.member_totals(df, "tract", counties, ["year"], natl="jobs")) == [(2010, 10)]
    assert rows(rollup.flagged_share(df, "jobs", ["year"], share="dense")) == [(2010, 0.2)]


def test_level_density_is_a_ratio_of_sums(spark, rows):
    df = spark.createDataFrame(
        [("01001a", 2010, 4, 1.0), ("01001b", 2010, 6, 4.0), ("02001a", 2010, 3, 0.0)],
        "tract string, year int, job_tot bigint, ALAND_SQMI double",
    )
    found = rollup.level_density(df, "tract", "state", "job_tot", "ALAND_SQMI")
    assert rows(found, "state", "jobs_sqmi") == [("01", 2.0), ("02", float("inf"))]


def test_missing_keys_match_each_other(spark, rows):
    left = spark.createDataFrame([("m", 1, 10), (None, 1, 20), ("x", 2, 30)], "cbsa string, year int, v int")
    right = spark.createDataFrame([("m", 1, 7), (None, 1, 8)], "cbsa string, year int, w int")
    expected = [("m", 1, 10, 7), ("x", 2, 30, None), (None, 1, 20, 8)]
    for join in (joins.join_nullsafe, joins.join_summary):
        found = join(left, right, ["cbsa", "year"])
        assert found.columns == ["cbsa", "year", "v", "w"]
        assert sorted(rows(found), key=str) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        joins.join_nullsafe(left, right, [])


def test_merge_periods(spark, rows):
    first = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    second = spark.createDataFrame([("a", 5), (None, 6), ("c", 7)], "k string, n int")
    inner = joins.merge_periods(first, second, ["k"], (" 2010", " 2015"))
    assert inner.columns == ["k", "n 2010", "n 2015"]
    assert rows(inner) == [(None, 3, 6), ("a", 1, 5)]
    full = joins.merge_periods(first.dropna(), second.dropna(), ["k"], ("_2010", "_2015"), how="full")
    assert rows(full) == [("a", 1, 5), ("b", 2, None), ("c", None, 7)]


def test_members_and_non_members(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, y int")
    listed = spark.createDataFrame([("a", 1), ("a", 1)], "k string, y int")
    assert rows(joins.members(df, "k", listed)) == [("a", 1)]
    assert rows(joins.non_members(df, listed, ["k"]), "k") == [(None,), ("b",)]


def test_remap_before_rollup_adds_merged_codes(spark, rows):
    df = spark.createDataFrame([("01001", 2010, 1), ("01002", 2010, 2)], "tract string, year int, n bigint")
    remap = spark.createDataFrame([("01002", "01001")], "old string, new string")
    found = rollup.rollup(lookup.remap_codes(df, "tract", remap), "tract", "tract")
    assert rows(found) == [("01001", 2010, 3)]


def test_crosswalk_subsets(spark, rows):
    crosswalk = spark.createDataFrame(
        [
            ("01001", "1", "One", "Metropolitan Statistical Area", 1),
            ("01002", "1", "One", "Metropolitan Statistical Area", 1),
            ("01003", "2", "Two", "Micropolitan Statistical Area", 0),
            ("01004", "14460", "Three", "Metropolitan Statistical Area", 1),
        ],
        "stcofips string, cbsa string, cbsa_name string, metro_micro string, top100 int",
    )
    assert lookup.metro_counties(crosswalk).count() == 3
    assert rows(lookup.top_metros(crosswalk, ("14460",))) == [("1", "One")]
    assert lookup.top_counties(crosswalk).count() == 3


def test_centres_are_filled_then_overridden(spark, rows):
    centres = spark.createDataFrame(
        [("a", "A", 0.0, 0.0), ("b", "B", None, None), ("c", "C", 1.0, 2.0), ("38300", "D", 0.0, 0.0), ("e", "E", 0.0, 5.0)],
        "cbsa string, cbsa_name string, lat double, lon double",
    )
    found = spark.createDataFrame([("a", 9.0, 8.0), ("c", 7.0, 7.0)], "cbsa string, lat double, lon double")
    filled = lookup.coords_backfill(centres, found, lookup.centre_overrides(centres))
    assert rows(filled, "cbsa", "lat", "lon") == [
        ("38300", 40.4313473, -80.05054), ("a", 9.0, 8.0), ("b", None, None), ("c", 1.0, 2.0), ("e", 0.0, 5.0),
    ]


def test_long_keeps_missing_and_wide_comes_back(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("b", 3, 4)], "k string, `2010` int, `2015` int")
    long = reshape.to_long(df, ["k"], ["2010", "2015"], "year", "jobs")
    assert long.count() == 4
    wide = reshape.to_wide(long, ["k"], "year", "jobs", ["2010", "2015"], prefix="year_")
    assert rows(wide) == [("a", 1, None), ("b", 3, 4)]


def test_full_join_matches_missing_keys(spark):
    first = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    second = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, v int")
    joined = joins.merge_periods(first, second, ["k"], ("_1", "_2"), how="full")
    assert joined.columns == ["k", "v_1", "v_2"]
    assert {tuple(r) for r in joined.collect()} == {(None, 1, 10), ("a", 2, 20), ("b", 3, None), ("c", None, 30)}
