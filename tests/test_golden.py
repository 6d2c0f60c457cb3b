"""Arithmetic of the published tables, replayed from their counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.operators import industry, summaries

# Published sector counts and shares, in the order of the sector list.
EMP_2010 = (
    1047502, 613127, 799551, 5243501, 11424228, 5401051, 13903433, 4182878, 2862877, 5375907,
    1929867, 7396578, 1916598, 7057881, 12547318, 17595798, 2115499, 10746759, 4330670, 6589231,
)
EMP_2015 = (
    1185034, 751571, 791561, 6346785, 12164577, 5793664, 15033396, 4825161, 2940709, 5631999,
    2085229, 8494400, 2301064, 8491771, 12541550, 19589021, 2338556, 12482023, 4248906, 6258405,
)
SHARE_2010 = {"naics_11": 0.85107234179091, "naics_62": 14.296198966245226, "naics_92": 5.353605298864593}
SHARE_2015 = {"naics_11": 0.8824085998727791, "naics_62": 14.586518693546738, "naics_92": 4.660178858570133}
TOTALS = {2010: 123080254, 2015: 134295382}

# Published jobs in clusters and their share, per cut and minimum.
CLUSTERS = (
    ("mapvar_10", 0.25, 34590758, 28.104230269138053, 37012721, 27.56068038139986),
    ("mapvar_10", 0.5, 29104947, 23.647129457500142, 30659430, 22.829846822283137),
    ("mapvar_10", 0.75, 24951105, 20.272224170093118, 26145900, 19.468949423741165),
    ("mapvar_5", 0.25, 46574619, 37.84085382209238, 49746979, 37.04295580320104),
    ("mapvar_5", 0.5, 38070912, 30.931778870069603, 40083386, 29.847181193467993),
    ("mapvar_5", 0.75, 32499013, 26.404733451395057, 33811317, 25.176827748254215),
    ("mapvar_20", 0.25, 24186776, 19.65122366419556, 25754260, 19.177323610427646),
    ("mapvar_20", 0.5, 21008299, 17.06878099227842, 21856714, 16.27510467932546),
    ("mapvar_20", 0.75, 18146518, 14.743646856627384, 18746460, 13.959124819347846),
)

# Published cluster shares and location quotients of some sectors.
MIX = (
    ("naics_11", 0.25, 0.13913253939101305, 0.16917967203762188, 0.16347909873118038, 0.19172486766562938),
    ("naics_92", 0.25, 9.237103159173326, 7.693557574435017, 1.7253986133666517, 1.650914655407798),
    ("naics_92", 0.75, 10.472650409671234, 8.971559594429719, 1.9561864995711025, 1.9251534901779352),
)


@pytest.fixture(scope="module")
def lehd(spark):
    codes = list(fv.SECTOR_LABELS)
    data = [
        ("24005400100", year, sum(emp), 1.0, *emp) for year, emp in ((2010, EMP_2010), (2015, EMP_2015))
    ]
    data.append(("25001000100", 2010, 99, 1.0, *([7] * 20)))  # an excluded state
    schema = "tract string, year int, job_tot bigint, ALAND_SQMI double, " + ", ".join(
        f"{c} bigint" for c in codes
    )
    return spark.createDataFrame(data, schema)


def test_industry_totals(lehd):
    found = {r.naics: r for r in industry.industry_totals(lehd, (2010, 2015)).collect()}
    assert set(found) == {*fv.SECTOR_LABELS, "Total"}
    for i, code in enumerate(fv.SECTOR_LABELS):
        row = found[code]
        assert (row.emp_2010, row.emp_2015) == (EMP_2010[i], EMP_2015[i])
        assert row.naics_label == fv.SECTOR_LABELS[code]
        assert row.job_change == EMP_2015[i] - EMP_2010[i]
        assert row.share_change == row.share_2015 - row.share_2010
    for code, share in SHARE_2010.items():
        assert found[code].share_2010 == pytest.approx(share, abs=1e-12)
        assert found[code].share_2015 == pytest.approx(SHARE_2015[code], abs=1e-12)
    whole = found["Total"]
    assert (whole.emp_2010, whole.emp_2015) == (TOTALS[2010], TOTALS[2015])
    assert whole.job_change == 11215128 and whole.naics_label is None
    assert whole.share_2010 == pytest.approx(100) and whole.share_change == pytest.approx(0, abs=1e-9)


def test_national_clusters(spark):
    data = []
    for cut, share, first, _, second, _ in CLUSTERS:
        for year, jobs in ((2010, first), (2015, second)):
            data.append((year, cut, share, "cluster", jobs, 1))
            data.append((year, cut, share, "low density", TOTALS[year] - jobs, 1))
    defined = spark.createDataFrame(
        data, "year int, num_quant string, pp_min double, mapvar string, job_tot bigint, _units bigint"
    )
    table = summaries.two_periods(
        summaries.national_clusters(defined), ["Density", "Minimum job share"], (2010, 2015), (" 2010", " 2015")
    )
    assert table.columns == [
        "Density", "Minimum job share", "Jobs in clusters 2010", "% of jobs in clusters 2010",
        "Jobs in clusters 2015", "% of jobs in clusters 2015",
    ]
    found = {(r[0], r[1]): tuple(r)[2:] for r in table.collect()}
    assert len(found) == 9
    for cut, share, *expected in CLUSTERS:
        row = found[fv.NATIONAL_CUT_NAMES[cut], share]
        assert (row[0], row[2]) == (expected[0], expected[2])
        assert row[1] == pytest.approx(expected[1], abs=1e-9)
        assert row[3] == pytest.approx(expected[3], abs=1e-9)


def test_location_quotients(spark, lehd):
    shares = spark.createDataFrame(
        [m[:4] for m in MIX], "naics string, pp_min double, x2010 double, x2015 double"
    )
    totals = industry.sector_totals(lehd, (2010, 2015))
    found = {
        (r.naics, r.pp_min): r for r in industry.location_quotient(shares, totals, (2010, 2015)).collect()
    }
    for naics, share, _, _, first, second in MIX:
        row = found[naics, share]
        assert row.naics_label == fv.SECTOR_LABELS[naics]
        assert row.lq_2010 == pytest.approx(first, rel=1e-12)
        assert row.lq_2015 == pytest.approx(second, rel=1e-12)


def test_cluster_sector_shares_add_to_100(spark):
    profile = spark.createDataFrame(
        [
            (2010, "cluster", "cluster", "cluster", 1, 2, 40, 30, 10),
            (2010, "cluster", "cluster", "cluster", 0, 1, 9, 4, 5),
            (2010, "p90", "cluster", "cluster", 1, 1, 60, 20, 40),
            (2010, "p80", "p80", "cluster", 1, 1, 60, 20, 40),
            (2015, "cluster", "cluster", "cluster", 1, 1, 50, 10, 40),
        ],
        "year int, mapvar_20 string, mapvar_10 string, mapvar_5 string, _exceeds int, _units bigint, "
        "job_tot bigint, naics_11 bigint, naics_21 bigint",
    )
    found = industry.industry_cluster_shares(profile, (2010, 2015), (0.25,))
    assert {(r.naics, r.x2010, r.x2015) for r in found.collect()} == {
        ("naics_11", 50.0, 20.0), ("naics_21", 50.0, 80.0),
    }
    sums = found.groupBy("pp_min").agg(F.sum("x2010"), F.sum("x2015")).first()
    assert tuple(sums) == (0.25, 100.0, 100.0)
