from __future__ import annotations

import pytest

from tessera.operators import reconcile


@pytest.fixture(scope="module")
def sources(spark):
    counts = spark.createDataFrame(
        [
            ("010010001001001", 2015, 100, 5, 40, 0, 55),
            ("010010002001001", 2015, 50, 0, 10, 20, 20),
            ("010030001001001", 2015, 80, 10, 70, 0, 0),
            ("020010001001001", 2015, 30, 0, 0, 30, 0),
        ],
        "fips string, year int, job_tot bigint, naics_11 bigint, naics_31to33 bigint, naics_81 bigint, naics_92 bigint",
    )
    raw = spark.createDataFrame(
        [
            ("01001", "RETAXAC", 0.160, 9.0),
            ("01001", "REMFAXAC", 0.050, 9.0),
            ("01001", "REGVLAXAC", 0.030, 9.0),
            ("01001", "REGVFAXAC", 0.060, 9.0),
            ("01003", "RETAXAC", 0.080, 9.0),
            ("01003", "REMFAXAC", 0.100, 9.0),
            ("01003", "RE11AXAC", 0.001, 9.0),
        ],
        "stcofips string, DBcode string, `2015` double, `1999` double",
    )
    crosswalk = spark.createDataFrame(
        [("01001", "1", "One-Two, ST", 1), ("01003", "2", "Solo, ST", 0)],
        "stcofips string, cbsa string, cbsa_name string, top100 int",
    )
    totals, by_sector = reconcile.prepare_second_source(raw)
    return reconcile.county_counts(counts), totals, by_sector, crosswalk


def near(*values):
    return tuple(v if isinstance(v, str) or v is None else pytest.approx(v, abs=1e-9) for v in values)


def test_second_source_is_split_and_merged(sources, rows):
    _, totals, by_sector, _ = sources
    assert totals.columns == ["stcofips", "industry", "y2015"]
    assert rows(totals, "stcofips", "y2015") == [("01001", 0.16), ("01003", 0.08)]
    merged = {(r.stcofips, r.naics): r.y2015 for r in by_sector.collect()}
    assert merged["01001", "naics_GV"] == pytest.approx(0.09)
    assert ("01003", "naics_11") in merged and len(merged) == 4


def test_county_check_drops_unmatched(sources, rows):
    counties, totals, *_ = sources
    check = reconcile.county_check(counties, totals, 2015)
    found = rows(check, "stcofips", "job_tot", "m_tot", "delta", "percent_delta")
    assert found == [near("01001", 150, 160, -10, -0.0625), near("01003", 80, 80, 0, 0)]
    overall = reconcile.overall_check(check).first()
    assert overall.percent_delta == pytest.approx(-10 / 240)


def test_sector_check_shows_unmatched_as_zero(sources, rows):
    counties, _, by_sector, _ = sources
    check = reconcile.sector_check(counties, by_sector, 2015)
    found = rows(check, "naics", "short_name", "jobs", "m_tot", "percent_delta")
    assert found == [
        near("naics_81", "81", 50, 0, float("inf")),
        near("naics_GV", "GV", 75, 90, -15 / 90),
        near("naics_MF", "MF", 120, 150, -0.2),
    ]
    long = reconcile.side_by_side(check)
    assert long.columns == ["naics", "short_name", "source", "job_ct"] and long.count() == 6


def test_metro_checks_keep_top_metros(sources, rows):
    counties, totals, by_sector, crosswalk = sources
    metros = reconcile.metro_check(counties, totals, crosswalk, 2015)
    assert rows(metros, "cbsa", "short_name", "job_tot", "delta") == [near("1", "One", 150, -10)]
    check = reconcile.metro_sector_check(counties, by_sector, crosswalk, 2015)
    found = {r.naics: r for r in check.collect()}
    assert set(found) == {"naics_11", "naics_MF", "naics_81", "naics_GV"}
    assert found["naics_81"].percent_delta == 0.0
    assert found["naics_MF"].delta_share == pytest.approx(0.0)
    assert found["naics_81"].delta_share == pytest.approx(20 / 150)
    bare = reconcile.metro_sector_check(counties, by_sector, crosswalk, 2015, guarded=False)
    assert {r.naics: r.percent_delta for r in bare.collect()}["naics_81"] == float("inf")


def test_wide_gap(sources, rows):
    counties, totals, _, crosswalk = sources
    metros = reconcile.metro_check(counties, totals, crosswalk, 2015)
    national = reconcile.overall_check(reconcile.county_check(counties, totals, 2015))
    ratio = national.select("percent_delta").scalar()
    assert rows(reconcile.wide_gap(metros, ratio), "cbsa", "wide_gap") == [("1", 1)]
    assert rows(reconcile.wide_gap(metros, 0.07), "cbsa", "wide_gap") == [("1", 0)]
