"""Partial moments, unit sets, buckets and order in space."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators.partials import (
    count_units,
    describe_moments,
    merge_moments,
    number_units,
    partial_moments,
    unit_sets,
)
from tessera.sources import layouts
from tests.compare import plan_of


def pairs(shift, seed=2, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) + shift
    y = 3 * (x - shift) + rng.normal(size=n) + shift / 2
    return [(f"s{i % 3}", f"c{i % 17}", 2010 + i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]


SCHEMA = "state string, county string, year int, x double, y double"


@pytest.mark.parametrize("shift", [0.0, 5.0, 1e7])
def test_moments_merge_to_the_direct_result(spark, shift):
    """Also where values are large and close, which sums of squares cannot tell apart."""
    rows = pairs(shift)
    fine = partial_moments(spark.createDataFrame(rows, SCHEMA), ["state", "county", "year"], "x", "y")
    for by in (["state", "year"], ["state"], []):
        got = describe_moments(merge_moments(fine, by), by).collect()
        groups = {}
        for s, _, year, x, y in rows:
            groups.setdefault(tuple({"state": s, "year": year}[b] for b in by), []).append((x, y))
        assert len(got) == len(groups)
        for r in got:
            x, y = np.array(groups[tuple(r[b] for b in by)], dtype=np.longdouble).T
            dx, dy = x - x.mean(), y - y.mean()
            slope = (dx * dy).sum() / (dx * dx).sum()
            want = [x.mean(), np.sqrt((dx * dx).sum() / (len(x) - 1)), (dx * dy).sum() / np.sqrt((dx * dx).sum() * (dy * dy).sum()), slope]
            assert r["n"] == len(x) and (r["min"], r["max"]) == (float(x.min()), float(x.max()))
            assert [r["mean"], r["sd"], r["correlation"], r["slope"]] == pytest.approx([float(w) for w in want], rel=1e-9)


def test_moments_of_missing_values_and_single_rows(spark):
    rows = [("a", "k", 1, 1.0, 2.0), ("a", "k", 1, None, 2.0), ("a", "l", 1, 3.0, None), ("b", "k", 1, None, None)]
    fine = partial_moments(spark.createDataFrame(rows, SCHEMA), ["state", "county"], "x", "y")
    got = describe_moments(merge_moments(fine, ["state"]), ["state"]).collect()
    assert [(r["state"], r["n"], r["mean"], r["sd"], r["correlation"], r["slope"]) for r in got] == [("a", 1, 1.0, None, None, None)]
    assert merge_moments(fine.filter("state = 'b'"), ["state"]).count() == 0


def test_units_are_counted_once_over_any_years(spark):
    rows = [(f"u{i % (1000 + 37 * y)}", 2000 + y, f"m{i % 3}") for y in range(4) for i in range(0, 3000, y + 1)]
    df = spark.createDataFrame(rows, "tract string, year int, cbsa string").repartition(5)
    numbers = number_units(df, "tract")
    assert numbers.count() == numbers.select("id").distinct().count() == len({r[0] for r in rows})
    sets = unit_sets(df, "tract", numbers, ["cbsa", "year"])
    for years in ([2000], [2001, 2003], [2000, 2001, 2002, 2003]):
        got = {r["cbsa"]: r["units"] for r in count_units(sets.filter(F.col("year").isin(years)), ["cbsa"]).collect()}
        want = {}
        for unit, year, metro in rows:
            if year in years:
                want.setdefault(metro, set()).add(unit)
        assert got == {m: len(u) for m, u in want.items()}
        assert count_units(sets.filter(F.col("year").isin(years)), []).first()[0] == len(set().union(*want.values()))


def test_new_units_are_numbered_after_the_known(spark):
    first = number_units(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string"), "k")
    both = number_units(spark.createDataFrame([("b",), ("c",), ("d",)], "k string"), "k", first)
    old, new = ({r["k"]: r["id"] for r in t.collect()} for t in (first, both))
    assert set(new) == {"a", "b", "c", "d"} and {k: new[k] for k in "ab"} == old
    assert min(new["c"], new["d"]) > max(old.values()) and len(set(new.values())) == 4


@pytest.fixture
def buckets(spark, tmp_path):
    counts = spark.range(3000).selectExpr("lpad(CAST(id % 211 AS STRING), 5, '0') AS tract", "CAST(id % 3 AS INT) AS year", "id AS jobs")
    areas = spark.range(200).selectExpr("lpad(CAST(id AS STRING), 5, '0') AS tract", "CAST(id AS DOUBLE) AS area")
    yield counts, areas, [
        layouts.save_buckets(t, f"layout_{n}", str(tmp_path / n), "tract", 6) for n, t in (("counts", counts), ("areas", areas))
    ]
    for name in ("layout_counts", "layout_areas"):
        layouts.drop_table(spark, name)


def test_sums_and_join_of_buckets_move_no_row(spark, buckets, rows, monkeypatch):
    counts, areas, (kept_counts, kept_areas) = buckets

    def result(c, a):
        return c.groupBy("tract", "year").agg(F.sum("jobs").alias("jobs")).join(a, "tract", "left")

    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(result(kept_counts, kept_areas))
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" in plan_of(result(counts, areas))
        assert rows(result(kept_counts, kept_areas)) == rows(result(counts, areas))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def squares(spark, n=40):
    corners = "array(array(" + ", ".join(
        f"named_struct('lon', CAST(x + {a} AS DOUBLE), 'lat', CAST(y + {b} AS DOUBLE))" for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    ) + "))"
    grid = spark.range(n * n).selectExpr(f"(id * 7919) % {n * n} AS i").selectExpr("i", f"i % {n} AS x", f"CAST(floor(i / {n}) AS BIGINT) AS y")
    return grid.selectExpr("lpad(CAST(i AS STRING), 6, '0') AS geoid", f"{corners} AS rings")


def test_a_window_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "layer")
    layouts.save_layer(squares(spark), path, rows_per_file=100)
    found = layouts.in_window(spark.read.parquet(path), 3.2, 5.1, 6.8, 8.9)
    assert {r["geoid"] for r in found.collect()} == {f"{x + 40 * y:06d}" for x in range(3, 7) for y in range(5, 9)}
    plan = plan_of(found)
    for limit in ("LessThanOrEqual(west,6.8)", "GreaterThanOrEqual(east,3.2)", "LessThanOrEqual(south,8.9)", "GreaterThanOrEqual(north,5.1)"):
        assert limit in plan
    met = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            met += (stats["west"].min <= 6.8 and stats["east"].max >= 3.2 and stats["south"].min <= 8.9 and stats["north"].max >= 5.1)
    assert total >= 16 and met <= total // 4


def test_layers_without_rows_or_extent(spark, tmp_path):
    layouts.save_layer(squares(spark).limit(0), str(tmp_path / "none"))
    assert layouts.in_window(spark.read.parquet(str(tmp_path / "none")), 0, 0, 9, 9).count() == 0
    one = squares(spark).filter("geoid = '000001'").unionByName(squares(spark).limit(1).selectExpr("'x' AS geoid", "CAST(NULL AS array<array<struct<lon:double,lat:double>>>) AS rings"))
    layouts.save_layer(one, str(tmp_path / "one"))
    assert [r["geoid"] for r in layouts.in_window(spark.read.parquet(str(tmp_path / "one")), 0, 0, 9, 9).collect()] == ["000001"]


def test_the_curve_keeps_neighbours_close(spark):
    cells = spark.range(64).selectExpr("CAST(id % 8 AS DOUBLE) AS x", "CAST(floor(id / 8) AS DOUBLE) AS y")
    keyed = cells.withColumn("z", layouts.space_key(F.col("x"), F.col("y"), (0.0, 0.0, 8.0, 8.0))).orderBy("z").collect()
    assert [(r["x"], r["y"]) for r in keyed[:4]] == [(0, 0), (1, 0), (0, 1), (1, 1)]
    assert len({r["z"] for r in keyed}) == 64 and {(r["x"] < 4, r["y"] < 4) for r in keyed[:16]} == {(True, True)}
