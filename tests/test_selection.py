"""Selection against brute force: hot groups, hot values, ties, NaN, missing values, plan shapes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.operators import selection
from tessera.operators.selection import flag_top, select_quantiles, select_tiles, select_top
from tests.test_ranking import brute_tiles


@pytest.fixture(params=["selected", "held"], autouse=True)
def path(request, monkeypatch):
    """Every test runs with all groups selected from, and with small ones held in one task."""
    if request.param == "selected":
        monkeypatch.setattr(selection, "WINDOW_ROWS", 0)
    return request.param


SCHEMA = "cbsa string, year int, tract string, density double, jobs bigint"


def skewed_rows(n=4000, seed=7):
    """Half the rows in one group, a third of those with one value; some missing, infinite or NaN."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        group = "hot" if i % 2 else rng.choice(["a", "b", "c", None, f"g{i % 60}"])
        value = 5.0 if rng.random() < 0.35 else rng.choice([float(rng.randrange(1000)) / 8, rng.random()])
        value = rng.choice([None, float("inf"), float("nan")]) if rng.random() < 0.06 else value
        rows.append((group, i % 2 + 2010, f"u{i * 7919 % n:05d}", value, i % 11))
    return rows + [("none", 2010, "u0", None, 3), ("one", 2010, "u0", 1.5, 4)]


@pytest.fixture(scope="module")
def skewed(spark):
    rows = skewed_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def grouped(rows):
    out = {}
    for group, year, unit, value, jobs in rows:
        out.setdefault((group, year), []).append((value, unit, jobs))
    return out


def in_order(members):
    """Spark's order: NaN is the largest value."""
    return sorted([(v, u) for v, u, _ in members if v is not None], key=lambda p: (np.isnan(p[0]), p[0], p[1]))


@pytest.mark.parametrize("method", ["large_first", "floor"])
def test_tiles_are_those_of_ntile(skewed, method):
    rows, df = skewed
    out = select_tiles(df, (20, 10, 5), ["cbsa", "year"], "density", ["tract"], method, {"whole": "jobs"}).collect()
    found = {(r.cbsa, r.year, r.tract): r for r in out}
    assert len(out) == len(rows)
    for key, members in grouped(rows).items():
        order, whole = in_order(members), sum(j for _, _, j in members)
        for n in (20, 10, 5):
            if method == "floor":
                tiles = [n * i // len(order) + 1 for i in range(len(order))]
            else:
                tiles = brute_tiles(len(order), n)[: len(order)]
            for (_, unit), tile in zip(order, tiles):
                row = found[(*key, unit)]
                assert (row[f"dense_cat_{n}"], row[f"most_dense_{n}"], row.whole) == (tile, tile == n, whole)
        for value, unit, _ in members:
            if value is None:
                assert found[(*key, unit)].dense_cat_20 is None and found[(*key, unit)].most_dense_20 is None


def test_a_large_group_is_bracketed(spark):
    """30,000 rows in one group, a third with one value; few rows stand inside the intervals."""
    rng = np.random.default_rng(3)
    values = np.where(rng.random(30_000) < 0.33, 50.0, rng.random(30_000) * 100)
    rows = [("g", 1, f"u{i:06d}", float(v), 1) for i, v in enumerate(rng.permutation(values))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = {r.tract: r.dense_cat_20 for r in select_tiles(df, (20,), ["cbsa"], "density", ["tract"]).collect()}
    order = sorted((v, u) for _, _, u, v, _ in rows)
    assert [found[u] for _, u in order] == brute_tiles(len(order), 20)
    top = {r.tract for r in select_top(df, [], "density", ["tract"]).collect()}
    tiles = brute_tiles(len(order), 100)
    assert top == {u for (_, u), t in zip(order, tiles) if t > 97}
    marked = flag_top(df, ["year"], "density", ["tract"], tiles=10, above=4).filter("top").count()
    assert marked == 18_000


@pytest.mark.parametrize("size", [1, 2, 3, 19, 20, 21, 99, 101, 399])
def test_tiles_of_small_groups(spark, size):
    rows = [("g", 1, f"u{i:04d}", float(i % 3), 1) for i in range(size)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.tract: (r.dense_cat_20, r.dense_cat_100) for r in select_tiles(df, (20, 100), [], "density", ["tract"]).collect()}
    order = sorted((v, u) for _, _, u, v, _ in rows)
    want = zip(brute_tiles(size, 20)[:size], brute_tiles(size, 100)[:size])
    assert [found[u] for _, u in order] == list(want)


def test_quantiles_with_a_hot_group_and_value(skewed):
    rows, df = skewed
    cuts = {"min": 0.0, "p10": 0.1, "median": 0.5, "p333": 1 / 3, "p95": 0.95, "max": 1.0}
    out = {(r.cbsa, r.year, r.measure): r for r in select_quantiles(df, ["cbsa", "year"], ["density", "jobs"], cuts).collect()}
    assert len(out) == 2 * len(grouped(rows))
    for key, members in grouped(rows).items():
        for measure, values in (("density", [v for v, _ in in_order(members)]), ("jobs", sorted(float(j) for *_, j in members))):
            row = out[(*key, measure)]
            assert row.n == len(values)
            for name, p in cuts.items():
                if not values:
                    assert row[name] is None
                    continue
                at = (len(values) - 1) * p
                lo, hi = values[int(np.floor(at))], values[int(np.ceil(at))]
                want = lo if lo == hi else lo + (at - np.floor(at)) * (hi - lo)
                assert row[name] == want or (np.isnan(row[name]) and np.isnan(want)) or abs(row[name] - want) < 1e-9


@pytest.mark.parametrize("shape", ["sorted", "reversed", "one hot", "heavy"])
def test_quantiles_of_a_large_group(spark, shape):
    n = 200_000
    value = {
        "sorted": "CAST(id AS DOUBLE)", "reversed": f"CAST({n} - id AS DOUBLE)",
        "one hot": "CASE WHEN id % 3 = 0 THEN 7D ELSE CAST(id * 7919 % 1000003 AS DOUBLE) END",
        "heavy": "exp((id * 7919 % 1000003) / 50000D)",
    }[shape]
    df = spark.range(0, n, 1, 16).selectExpr("'g' AS g", f"{value} AS v")
    got = select_quantiles(df, ["g"], ["v"], {"a": 0.01, "b": 0.5, "c": 0.8, "d": 0.999}).first()
    values = np.array([r.v for r in df.select("v").collect()])
    assert [got[c] for c in "abcd"] == pytest.approx(np.quantile(values, [0.01, 0.5, 0.8, 0.999]).tolist(), rel=1e-12)


def test_no_group_and_no_rows(spark):
    df = spark.range(11).selectExpr("CAST(id AS DOUBLE) AS v", "CAST(id AS STRING) AS tract")
    assert [tuple(r) for r in select_quantiles(df, [], ["v"], {"m": 0.5}).collect()] == [("v", 11, 5.0)]
    assert select_tiles(df.limit(0), (5,), [], "v", ["tract"]).count() == 0
    assert select_top(df.limit(0), [], "v", ["tract"]).count() == 0


def test_no_range_exchange_and_no_copy(spark, skewed, monkeypatch, path):
    _, df = skewed
    staged, stage = [], selection.stage
    monkeypatch.setattr(selection, "stage", lambda d, label: staged.append((label, stage(d, label))) or staged[-1][1])
    out = [
        select_quantiles(df, ["cbsa", "year"], ["density"], {"p90": 0.9}),
        select_tiles(df, (20, 10, 5), ["cbsa", "year"], "density", ["tract"]),
        select_top(df, ["year"], "density", ["tract"]),
    ]
    for plan in out:
        assert "rangepartitioning" not in plan._jdf.queryExecution().toString().lower()
    # What is staged has one row per group, cut or hot value: none of the 4,002 rows.
    small = {"large-groups", "brackets", "cuts"}
    assert {label for label, _ in staged} == (set() if path == "held" else {*small, "hot-values", "cut-values", "cut-units"})
    assert all(table.count() < 150 for label, table in staged if label in small)


def test_both_paths_in_one_table(spark, skewed, monkeypatch):
    """Groups on both sides of the limit."""
    rows, df = skewed
    monkeypatch.setattr(selection, "WINDOW_ROWS", 500)
    found = {(r.cbsa, r.year, r.tract): r.dense_cat_20 for r in select_tiles(df, (20,), ["cbsa", "year"], "density", ["tract"]).collect()}
    assert len(found) == len(rows)
    for key, members in grouped(rows).items():
        order = in_order(members)
        assert [found[(*key, u)] for _, u in order] == brute_tiles(len(order), 20)[: len(order)]
    cuts = {(r.cbsa, r.year): r.q for r in select_quantiles(df, ["cbsa", "year"], ["jobs"], {"q": 0.25}).collect()}
    assert cuts == {k: np.quantile([j for *_, j in m], 0.25) for k, m in grouped(rows).items()}


def test_unknown_method(skewed):
    with pytest.raises(ValueError, match="method"):
        select_tiles(skewed[1], (5,), ["cbsa"], "density", ["tract"], "other")
