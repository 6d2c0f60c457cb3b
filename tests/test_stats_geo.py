from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.operators import geo, stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(11)
    data = [
        (f"t{i:04d}", 2010 + 5 * (i % 2), "m" if i % 3 else None, rng.choice([None, float("inf"), *[rng.gammavariate(2, 900) for _ in range(30)]]))
        for i in range(800)
    ]
    return data, spark.createDataFrame(data, "tract string, year int, cbsa string, density double").cache()


def values(data, year, finite=True):
    return np.array([v for _, y, _, v in data if y == year and v is not None and (not finite or math.isfinite(v))])


def test_histogram_matches_numpy(sample):
    data, df = sample
    found = stats.histogram(df, "density", ["year"]).collect()
    for year in (2010, 2015):
        counts, edges = np.histogram(values(data, year), bins=30)
        mine = {r.bin: r for r in found if r.year == year}
        assert {b: r.n for b, r in mine.items()} == {b: c for b, c in enumerate(counts) if c}
        assert mine[0].lower == edges[0] and mine[0].upper == pytest.approx(edges[1])


def test_polygon_has_every_bin(sample):
    data, df = sample
    found = stats.freq_polygon(df, "density", ["year"], bins=50).collect()
    assert len(found) == 100
    assert sum(r.n for r in found if r.year == 2010) == len(values(data, 2010))


def test_histogram_of_one_value(spark, rows):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, v double")
    assert rows(stats.histogram(df, "v", ["g"]), "bin", "n") == [(0, 2)]


def test_density_curve_is_close_to_the_exact_kernel_sum(sample):
    data, df = sample
    found = stats.density_curve(df, "density", ["year"], ["tract"]).collect()
    for year in (2010, 2015):
        x = values(data, year)
        x = x[x <= 15000]
        iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
        bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
        mine = {r.point: r for r in found if r.year == year}
        assert len(mine) == 512 and mine[511].x == pytest.approx(15000)
        for point in (0, 3, 40, 100, 300):
            grid = mine[point].x
            exact = np.exp(-0.5 * ((grid - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
            assert mine[point].y == pytest.approx(exact, rel=1e-4, abs=1e-12)


def test_curve_needs_two_values_and_survives_ties(spark):
    df = spark.createDataFrame(
        [("one", "a", 5.0), ("tie", "a", 5.0), ("tie", "b", 5.0)], "g string, u string, v double"
    )
    found = stats.density_curve(df, "v", ["g"], ["u"], points=8, bins=16).collect()
    assert {r.g for r in found} == {"tie"} and len(found) == 8


def test_box_stats(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 40.0, -30.0]
    df = spark.createDataFrame([("g", f"{i:02d}", v) for i, v in enumerate(x)], "g string, u string, v double")
    row = stats.box_stats(df, "v", ["g"], ["u"]).first()
    assert (row.q1, row.median, row.q3) == tuple(np.quantile(x, [0.25, 0.5, 0.75]))
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 9.0, 2)


def test_six_number_summary(sample):
    data, df = sample
    found = {r.year: r for r in stats.six_number_summary(df, ["density"], ["tract"], ["year"]).collect()}
    for year, row in found.items():
        every = values(data, year, finite=False)
        assert row.missing == sum(1 for _, y, _, v in data if y == year and v is None)
        assert row.min == every.min() and row.max == every.max()
        assert row.median == pytest.approx(np.quantile(every, 0.5))


def test_flags_frequencies_and_argmax(spark, rows):
    df = spark.createDataFrame(
        [("a", True, "x", 3, 1.5), ("b", False, "x", 9, 2.5), ("c", None, None, 9, 3.5), ("d", True, "y", None, 4.5)],
        "tract string, f boolean, name string, pop bigint, area double",
    )
    assert rows(stats.flag_counts(df, "f")) == [(2, 1, 1)]
    assert rows(stats.freq_table(df, "name")) == [("x", 2), ("y", 1)]
    assert rows(stats.argmax(df, [], "pop", "tract", ["area"])) == [("b", 9, 2.5)]


def test_rank_categories_and_fill(spark, rows):
    df = spark.createDataFrame([("x", 1.0), ("x", 5.0), ("y", 4.0), ("z", 3.0)], "name string, v double")
    assert rows(stats.rank_categories(df, "name", "v")) == [("x", 3.0, 2), ("y", 4.0, 1), ("z", 3.0, 3)]
    filled = stats.stack_fill(df, ["name"], "v").orderBy("name", "v")
    assert [round(r.part, 6) for r in filled.collect()] == [0.166667, 0.833333, 1.0, 1.0]


def test_fit_and_correlation(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0])
    y = np.array([3.0, 5.0, 8.0, 21.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = stats.linear_fit(df, "y", "x").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(intercept)
    assert fit.r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2) and fit.n == 4


def test_places_population_and_coverage(spark, rows):
    lehd = spark.createDataFrame(
        [(f"{c}{i:06d}", 2015, i, 1.0) for c in ("01001", "01003") for i in range(100)],
        "tract string, year int, job_tot bigint, ALAND_SQMI double",
    )
    crosswalk = spark.createDataFrame(
        [("01001", "1", "One-Two", 1)], "stcofips string, cbsa string, cbsa_name string, top100 int"
    )
    places = stats.job_places(lehd)
    dense = stats.most_dense(places)
    assert dense.count() == 6
    assert rows(stats.dense_coverage(dense, crosswalk)) == [(2015, 1, 3, 3)]
    share = stats.dense_share(places, "job_tot", "jobs_sqmi").first()
    assert share.dense_share == pytest.approx(2 * (97 + 98 + 99) / (2 * 4950)) and share.dense_units == 6
    medians = stats.metro_medians(places, crosswalk, dense).first()
    assert (medians.job_tot, medians.jobs_sqmi, medians.Freq, medians.short_name) == (49.5, 49.5, 3, "One")
    usual = stats.ordinary_places(places, crosswalk, dense)
    assert usual.count() == 97

    population = spark.createDataFrame([(f"01001{i:06d}", 2 * i) for i in range(100)], "tract string, pop bigint")
    area = lehd.select("tract", "ALAND_SQMI")
    pop = stats.pop_density(population, area, crosswalk)
    assert pop.filter("short_name = 'One'").count() == 100
    corr = stats.density_corr(places, pop).first()
    assert (round(corr.correlation, 9), corr.units, corr.unmatched) == (1.0, 100, 100)


def test_boundaries(spark, rows):
    bounds = spark.createDataFrame(
        [("01001a", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0)]]), ("09009b", [[(2.0, 2.0)]])],
        "geoid string, rings array<array<struct<lon:double,lat:double>>>",
    )
    vertices = geo.boundary_vertices(bounds, "tract")
    assert sorted(tuple(r) for r in vertices.collect()) == sorted(
        [
            (0.0, 0.0, 1, 1, "01001a"), (1.0, 0.0, 2, 1, "01001a"), (0.0, 0.0, 3, 1, "01001a"),
            (5.0, 5.0, 4, 2, "01001a"), (6.0, 5.0, 5, 2, "01001a"), (2.0, 2.0, 1, 1, "09009b"),
        ]
    )
    units = spark.createDataFrame([("01001a", 3, "cluster"), ("77777x", 1, "p80")], "tract string, job_tot int, mapvar_20 string")
    layer = geo.geo_attribute_join(units, bounds)
    assert layer.columns == ["geoid", "rings", "tract", "job_tot", "mapvar_20"] and layer.count() == 1
    crosswalk = spark.createDataFrame([("01001", "1"), ("01003", "2")], "stcofips string, cbsa string")
    assert rows(geo.select_group_units(units, "1", crosswalk), "tract") == [("01001a",)]
    dense = spark.createDataFrame([("01001a", 2015, 2.0), ("01001a", 2015, 5.0), ("01001a", 2010, 1.0)], "tract string, year int, jobs_sqmi double")
    filled = geo.choropleth_rows(vertices, dense, "tract").collect()
    assert len(filled) == 11  # five vertices in two years, one vertex unfilled
    assert {(r["tract"], r["year"], r["dense_places"], r["top_jobs_sqmi"]) for r in filled} == {
        ("01001a", 2015, 2, 5.0), ("01001a", 2010, 1, 1.0), ("09009b", None, None, None)}
