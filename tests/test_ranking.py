"""Ranks, tiles and quantiles against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.operators.ranking import (
    approximate_quantiles,
    quantiles,
    rank_rows,
    tile_sql,
    top_tiles,
    with_tiles,
)


def brute_tiles(size: int, tiles: int) -> list[int]:
    """SQL ntile: the larger tiles come first."""
    small, extra = divmod(size, tiles)
    sizes = [small + 1] * extra + [small] * (tiles - extra)
    return [t + 1 for t, n in enumerate(sizes) for _ in range(n)]


@pytest.fixture(scope="module")
def skewed(spark):
    """Half the rows in one group, a third of those with one value; some missing."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        group = "hot" if i % 2 else rng.choice(["a", "b", "c", None])
        value = 5.0 if rng.random() < 0.35 else float(rng.randrange(1000)) / 8
        if rng.random() < 0.05:
            value = None
        data.append((group, i % 2 + 2010, f"u{i:05d}", value, i % 11))
    return data, spark.createDataFrame(
        data, "cbsa string, year int, tract string, density double, jobs bigint"
    ).repartition(6)


def groups_of(data):
    found = {}
    for group, year, unit, value, jobs in data:
        found.setdefault((group, year), []).append((value, unit, jobs))
    return found


def test_rank_is_exact_with_hot_group_and_hot_value(skewed):
    data, df = skewed
    ranked = rank_rows(df, ["cbsa", "year"], "density", ["tract"], group_totals={"whole": "jobs"})
    found = {r.tract: (r["rank"], r.group_size, r.whole) for r in ranked.collect()}
    assert len(found) == len(data)
    for members in groups_of(data).values():
        valued = sorted((v, u) for v, u, _ in members if v is not None)
        whole = sum(j for _, _, j in members)
        for position, (_, unit) in enumerate(valued, 1):
            assert found[unit] == (position, len(valued), whole)
        for value, unit, _ in members:
            if value is None:
                assert found[unit] == (None, len(valued), whole)


def test_tiles_match_sql_ntile(skewed):
    data, df = skewed
    tiled = with_tiles(df, (20, 10, 5), ["cbsa", "year"], "density", ["tract"])
    found = {r.tract: r for r in tiled.collect()}
    for members in groups_of(data).values():
        valued = sorted((v, u) for v, u, _ in members if v is not None)
        for n in (20, 10, 5):
            for (_, unit), tile in zip(valued, brute_tiles(len(valued), n)):
                assert found[unit][f"dense_cat_{n}"] == tile
                assert found[unit][f"most_dense_{n}"] == (tile == n)
        for value, unit, _ in members:
            if value is None:
                assert found[unit].dense_cat_20 is None and found[unit].most_dense_20 is None


def test_more_partitions_do_not_change_ranks(spark, skewed):
    _, df = skewed
    before = {r.tract: r["rank"] for r in rank_rows(df, ["cbsa"], "density", ["tract"]).collect()}
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ranked = rank_rows(df, ["cbsa"], "density", ["tract"])
        assert {r.tract: r["rank"] for r in ranked.collect()} == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_no_range_holds_the_hot_group_or_value(spark, monkeypatch):
    placed, stage = [], ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, label: placed.append(stage(df, label)) or placed[-1])
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    df = spark.range(24000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' ELSE CAST(id % 50 AS STRING) END AS g",
        "CASE WHEN id % 2 = 0 THEN 1D ELSE CAST(id AS DOUBLE) END AS v",
        "CAST(id AS STRING) AS u",
    )
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        rank_rows(df, ["g"], "v", ["u"])
        sizes = [r[0] for r in placed[0].groupBy(F.expr("shiftright(_pos, 33)")).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 24000 and len(sizes) == 12 and max(sizes) < 2 * 24000 / 12


def test_descending_rank_puts_missing_last(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None), ("d", 3.0)], "k string, v double")
    ranked = rank_rows(df, [], "v", ["k"], descending=True)
    assert rows(ranked, "k", "rank") == [("a", 3), ("b", 1), ("c", None), ("d", 2)]


@pytest.mark.parametrize("tiles", [3, 4, 5, 20])
def test_tile_formula(spark, tiles):
    sizes = range(1, 45)
    data = [(rank, size) for size in sizes for rank in range(1, size + 1)]
    df = spark.createDataFrame(data, "r bigint, n bigint").select(
        "r", "n",
        F.expr(tile_sql("r", "n", tiles)).alias("sql"),
        F.expr(tile_sql("r", "n", tiles, "floor")).alias("floor"),
    )
    found = {(r.r, r.n): (r.sql, r.floor) for r in df.collect()}
    for size in sizes:
        expected = brute_tiles(size, tiles)
        for rank in range(1, size + 1):
            assert found[rank, size] == (expected[rank - 1], tiles * (rank - 1) // size + 1)


def test_tile_methods_differ_only_in_sizes(spark):
    df = spark.createDataFrame([(r, 10) for r in range(1, 11)], "r bigint, n bigint")
    for method, sizes in (("large_first", [3, 3, 2, 2]), ("floor", [3, 2, 3, 2])):
        tiles = [r[0] for r in df.select(F.expr(tile_sql("r", "n", 4, method))).collect()]
        assert [tiles.count(t) for t in (1, 2, 3, 4)] == sizes
    with pytest.raises(ValueError):
        tile_sql("r", "n", 4, "other")


def test_top_tiles_of_whole_table(spark, rows):
    df = spark.createDataFrame([(f"{i:03d}", float(i)) for i in range(200)], "k string, v double")
    assert rows(top_tiles(df, [], "v", ["k"]), "k") == [(f"{i:03d}",) for i in range(194, 200)]


def test_quantiles_match_numpy(skewed):
    data, df = skewed
    probabilities = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {
        (r.cbsa, r.year, r.measure): r
        for r in quantiles(df, ["cbsa", "year"], ["density", "jobs"], ["tract"], probabilities).collect()
    }
    for (group, year), members in groups_of(data).items():
        for measure, values in (
            ("density", [v for v, _, _ in members if v is not None]),
            ("jobs", [j for _, _, j in members]),
        ):
            row = found[group, year, measure]
            assert row.n == len(values)
            for name, p in probabilities.items():
                assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_quantiles_of_nothing_are_missing(spark, rows):
    df = spark.createDataFrame([("g", "a", None), ("h", "b", 4.0)], "g string, u string, v double")
    found = quantiles(df, ["g"], ["v"], ["u"], {"p50": 0.5})
    assert rows(found, "g", "n", "p50") == [("g", 0, None), ("h", 1, 4.0)]


def test_quantiles_keep_infinity(spark, rows):
    values = [1.0, 2.0, float("inf"), float("inf")]
    df = spark.createDataFrame([("g", str(i), v) for i, v in enumerate(values)], "g string, u string, v double")
    found = quantiles(df, ["g"], ["v"], ["u"], {"low": 0.25, "high": 0.9})
    assert rows(found, "low", "high") == [(1.75, float("inf"))]


def test_approximate_quantiles(spark, rows):
    df = spark.createDataFrame([("g", float(i)) for i in range(101)], "g string, v double")
    assert rows(approximate_quantiles(df, ["g"], "v", {"p80": 0.8})) == [("g", 80.0)]
