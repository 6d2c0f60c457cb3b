"""Precomputed tables and the views over them."""

from __future__ import annotations

import pytest

from tessera import fixed_values as fv
from tessera.operators import clusters, density
from tessera.plans import dashboard
from tests.compare import plan_of


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    counties = {"24005": ("1", "One-Two, MD"), "24007": ("1", "One-Two, MD"), "25001": ("14460", "Gone, MA"), "06001": ("3", "Three")}
    data, shapes = [], []
    for county, (_, _) in counties.items():
        for i in range(60):
            tract = f"{county}{i:06d}"
            shapes.append((tract, [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]))
            for year in (2010, 2015):
                data.append((tract, year, i * 10 + (year - 2010), 0.5 if i % 7 else 2.0))
    data.append(("99999000001", 2015, 5, 1.0))
    lehd = spark.createDataFrame(data, "tract string, year int, job_tot bigint, ALAND_SQMI double")
    crosswalk = spark.createDataFrame(
        [(c, m, n, int(m != "3")) for c, (m, n) in counties.items()],
        "stcofips string, cbsa string, cbsa_name string, top100 int",
    )
    bounds = spark.createDataFrame(shapes[1:], "geoid string, rings array<array<struct<lon:double,lat:double>>>")
    centres = spark.createDataFrame([("1", 39.0, -76.0), ("14460", 42.0, -71.0)], "cbsa string, lat double, lon double")
    dense = density.compute_density(lehd, "job_tot", crosswalk)
    categories = clusters.map_categories(density.density_tiles(dense, metro_total="job_tot"))
    folder = str(tmp_path_factory.mktemp("board"))
    dashboard.build(categories, crosswalk, bounds, centres, folder)
    return dashboard.Dashboard(spark, folder), categories.toPandas()


METRO = "One-Two, MD"


def test_metro_list_leaves_out_excluded(board, rows):
    assert rows(board[0].metros(), "cbsa", "lat") == [("1", 39.0)]


@pytest.mark.parametrize("choice,minimum", [(1, 0), (2, 0.25), (3, 1), (3, 0.33)])
def test_cluster_view(board, choice, minimum):
    view, places = board
    found = {r.tract: r for r in view.cluster_view(METRO, 2015, choice, minimum).collect()}
    metro = places[(places["cbsa"] == "1") & (places["year"] == 2015)]
    least = metro["job_tot"].sum() * (minimum / 100 if minimum in fv.MINIMUM_SHARES else 0)
    assert len(found) == len(metro) - 1  # one place has no boundary
    for row in metro.itertuples():
        if row.tract not in found:
            continue
        category = getattr(row, fv.CUT_CHOICES[choice])
        if category == "cluster" and row.job_tot <= least:
            category = "high density"
        assert found[row.tract].mapvar == category
        assert found[row.tract].rings[0][1].lon == 1.0


def test_view_reads_one_year_and_pushes_the_metro(board):
    plan = plan_of(board[0].cluster_view(METRO, 2015, 2, 0.25))
    assert "PartitionFilters: [isnotnull(year" in plan
    assert plan.count("EqualTo(cbsa_name,One-Two, MD)") == 2


def test_excluded_state_is_hidden_but_summarised(board):
    view, _ = board
    assert view.cluster_view("Gone, MA", 2015, 1, 0).count() == 0
    assert view.overview("Gone, MA", 2015).count() == 15


def test_overview_is_sorted_and_falls_with_the_minimum(board):
    found = board[0].overview(METRO, 2010).collect()
    assert [(r[1], r[0]) for r in found] == sorted((r[1], r[0]) for r in found) and len(found) == 15
    for cut in fv.METRO_CUT_NAMES.values():
        counts = [r["Number of clusters"] for r in found if r["Density threshold"] == cut]
        assert counts == sorted(counts, reverse=True)


def test_describe(board):
    row = board[0].describe(METRO, 2015).first()
    assert (row.cbsa, row.tr_ct, row.lat, row.lon) == ("1", 120, 39.0, -76.0)
    assert row.jobs == 2 * sum(i * 10 + 5 for i in range(60))


def test_distribution_has_markers(board):
    found = board[0].distribution(METRO, 2015).collect()
    assert len(found) == 512
    assert len({(r.p80, r.p90, r.p95) for r in found}) == 1
    assert found[0].p80 < found[0].p90 < found[0].p95


def test_places_are_sorted_by_metro_inside_each_file(board):
    view = board[0]
    files = view.table("places").inputFiles()
    for file in files:
        names = [r["cbsa_name"] for r in view.spark.read.parquet(file).collect()]
        assert names == sorted(names, key=lambda n: (n is not None, n or ""))
    assert files
