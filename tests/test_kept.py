"""Kept stages by period, code chains and splits, problem rows, key widths."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import keys
from tessera.operators import density, geo, rollup
from tessera.operators.clusters import cluster_flags, metro_minimums
from tessera.operators.lookup import resolve_codes, split_codes
from tessera.operators.reconcile import county_counts
from tessera.operators.stats import job_places, pop_density
from tessera.sources.files import scan_tsv
from tessera.sources.kept import KeptStage, files_version, keep_once

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("year", T.IntegerType())])


def listing(path):
    """Data files below a folder with their times."""
    return {
        os.path.relpath(os.path.join(root, f), path): os.stat(os.path.join(root, f)).st_mtime_ns
        for root, _, files in os.walk(path) for f in files if f.endswith(".parquet") and "_manifest" not in root
    }


def test_only_changed_periods_are_rebuilt(spark, tmp_path, rows):
    path, asked = str(tmp_path / "kept"), []

    def build(factor):
        def some(years):
            asked.append(years)
            data = [(k, factor * y, y) for y in years for k in "ab"]
            return spark.createDataFrame(data, SCHEMA)

        return some

    kept = KeptStage(spark, path)
    assert kept.versions() == {}
    assert kept.refresh({2010: "a", 2011: "a", 2012: "a"}, build(1)) == [2010, 2011, 2012]
    first = listing(path)
    assert kept.refresh({2010: "a", 2011: "a", 2012: "a"}, build(5)) == [] and listing(path) == first
    # 2011 is revised, 2013 is new, 2012 is gone.
    assert kept.refresh({2010: "a", 2011: "b", 2013: "a"}, build(2)) == [2011, 2013]
    assert asked == [[2010, 2011, 2012], [2011, 2013]]
    second = listing(path)
    same = [f for f in first if "year=2010" in f]
    assert same and all(first[f] == second.get(f) for f in same)
    assert not any("year=2012" in f for f in second)
    assert rows(kept.read(SCHEMA)) == sorted([(k, f * y, y) for y, f in ((2010, 1), (2011, 2), (2013, 2)) for k in "ab"],
                                             key=lambda t: [str(v) for v in t])
    assert KeptStage(spark, path).versions() == {"2010": "a", "2011": "b", "2013": "a"}


def test_a_broken_refresh_is_made_good(spark, tmp_path):
    kept = KeptStage(spark, str(tmp_path / "kept"))
    good = lambda years: spark.createDataFrame([("a", 1, y) for y in years], SCHEMA)
    kept.refresh({2010: "a", 2011: "a"}, good)

    def fails(years):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        kept.refresh({2010: "a", 2011: "b"}, fails)
    assert kept.versions() == {"2010": "a"}
    assert kept.refresh({2010: "a", 2011: "b"}, good) == [2011]
    assert kept.read(SCHEMA).count() == 2


def test_a_period_without_rows(spark, tmp_path):
    kept = KeptStage(spark, str(tmp_path / "kept"))
    kept.refresh({2010: "a", 2011: "a"}, lambda years: spark.createDataFrame([("a", 1, y) for y in years], SCHEMA))
    assert kept.refresh({2010: "a", 2011: "b"}, lambda years: spark.createDataFrame([], SCHEMA)) == [2011]
    assert [r.year for r in kept.read(SCHEMA).collect()] == [2010]
    assert kept.refresh({2010: "a", 2011: "b"}, lambda years: 1 / 0) == []


def test_versions_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    first = files_version(spark, path)
    assert files_version(spark, path) == first
    spark.range(1).write.mode("append").parquet(path)
    assert files_version(spark, path) != first


def test_kept_once(spark, tmp_path):
    folder, calls = str(tmp_path / "board"), []
    build = lambda at: (calls.append(at), spark.range(3).write.parquet(f"{at}/t"))
    assert keep_once(spark, folder, build) == keep_once(spark, folder, build) == folder
    assert len(calls) == 1 and spark.read.parquet(f"{folder}/t").count() == 3


HOPS = [("a", "b", 1), ("b", "c", 1), ("c", "x", 1), ("c", "y", 2), ("m", "x", 9), ("n", "m", 3), ("s", "s1", 1), ("s", "s2", 1), ("s2", "z", 4)]


def test_chains_are_followed_to_the_end(spark):
    found = resolve_codes(spark.createDataFrame(HOPS, "old string, new string, weight long")).collect()
    ends = {(r.old, r.new): r.num / r.den for r in found}
    third = {"x": 1 / 3, "y": 2 / 3}
    want = {(o, n): p for o in "abc" for n, p in third.items()} | {("m", "x"): 1, ("n", "x"): 1, ("s", "s1"): 0.5, ("s", "z"): 0.5, ("s2", "z"): 1}
    assert ends == pytest.approx(want)


@pytest.mark.parametrize("circle", [[("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]])
def test_circles_are_errors(spark, circle):
    with pytest.raises(ValueError, match="circle"):
        resolve_codes(spark.createDataFrame(circle, "old string, new string"))


def test_a_long_chain_takes_few_joins(spark):
    hops = spark.range(200).selectExpr("CAST(id AS STRING) AS old", "CAST(id + 1 AS STRING) AS new")
    assert {r.new for r in resolve_codes(hops).collect()} == {"200"}


def test_whole_counts_add_up_after_splits(spark):
    hops = spark.createDataFrame(HOPS + [("t", "t1", 1), ("t", "t2", 1), ("t", "t3", 1)], "old string, new string, weight long")
    data = [(k, y, n, n * 10, "keep") for y, n in ((2010, 1), (2011, 7), (2012, 100)) for k in ("a", "c", "n", "s", "t", "other")]
    data += [("t", 2013, None, -7, "keep"), (None, 2014, 3, 3, "keep")]
    df = spark.createDataFrame(data, "tract string, year int, jobs bigint, more bigint, note string")
    out = split_codes(df, "tract", hops, ["jobs", "more"])
    assert out.columns == df.columns
    got = out.collect()
    for measure in ("jobs", "more"):
        before, after = Counter(), Counter()
        for r in df.collect():
            before[r.year] += r[measure] or 0
        for r in got:
            after[r.year] += r[measure] or 0
        assert before == after
    by = {(r.tract, r.year): r.jobs for r in got if r.tract in ("t1", "t2", "t3", "other", None)}
    assert [by[(t, 2010)] for t in ("t1", "t2", "t3")] == [1, 0, 0] and [by[(t, 2011)] for t in ("t1", "t2", "t3")] == [3, 2, 2]
    assert by[("t1", 2013)] is None and by[("other", 2011)] == 7 and by[(None, 2014)] == 3
    assert sorted(r.more for r in got if r.year == 2013) == [-3, -2, -2]
    assert {r.jobs for r in got if r.tract == "y" and r.year == 2012} == {67}


def test_problem_rows(spark, tmp_path):
    for name, lines in {
        "one.tsv": ["k\tv\tw", "a\t1\t2.5", "b\tx\t3", "c\t\tbad", "d\t4"], "two.tsv": ["k\tv\tw", "e\t 5 \t1e3", "f\t9\t1\t7", "g\t1.5\tNaN"],
    }.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    good, problems = scan_tsv(spark, str(tmp_path), T.StructType.fromDDL("w double, k string, v int"))
    found = sorted((r.file, r.row, r.column or "", r.expected, r.raw) for r in problems.collect())
    assert found == [
        ("one.tsv", 2, "v", "int", "x"), ("one.tsv", 3, "w", "double", "bad"), ("one.tsv", 4, "", None, "d\t4"),
        ("two.tsv", 2, "", None, "f\t9\t1\t7"), ("two.tsv", 3, "v", "int", "1.5"),
    ]
    rows = {r.k: (r.v, r.w) for r in good.collect()}
    assert len(rows) == 7 and rows["a"] == (1, 2.5) and rows["b"] == (None, 3.0) and rows["c"] == (None, None) and rows["e"] == (5, 1000.0)


def test_problem_rows_of_files_read_in_pieces(spark, tmp_path):
    lines = ["k\tv"] + [f"k{i}\t{'bad' if i % 97 == 5 else i}" for i in range(4000)]
    (tmp_path / "big.tsv").write_text("\n".join(lines) + "\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        good, problems = scan_tsv(spark, str(tmp_path), T.StructType.fromDDL("k string, v int"))
        assert good.rdd.getNumPartitions() > 4
        found = sorted(r.row for r in problems.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert found == [i + 1 for i in range(4000) if i % 97 == 5]
    assert good.filter("v IS NULL").count() == len(found)


def test_a_missing_column(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tv\n1\t2\n")
    with pytest.raises(ValueError, match="no column z"):
        scan_tsv(spark, str(tmp_path), T.StructType.fromDDL("z int"))


def test_keys_of_other_widths(spark):
    """Counties of three characters and states of one, in every function that cuts a key."""
    widths = {"state": 1, "county": 3, "tract": 5, "blkgrp": 6}
    blocks = spark.createDataFrame([("1aa11x1", 2010, 5), ("1aa12y2", 2010, 6), ("2bb11x3", 2010, 7)], "fips string, year int, job_tot bigint")
    areas = spark.createDataFrame([("1aa11x1", 1.0), ("1aa12y2", 2.0), ("2bb11x3", 4.0)], "fips string, ALAND_SQMI double")
    metros = spark.createDataFrame([("1aa", "M", "Metro", 1), ("2bb", "N", "Nowhere", 0)], "stcofips string, cbsa string, cbsa_name string, top100 int")
    tracts = rollup.rollup(blocks, "fips", "tract", ["year"], widths=widths)
    area = rollup.rollup(areas, "fips", "tract", [], widths=widths)
    lehd = tracts.join(area, "tract")
    dense = density.compute_density(lehd, "job_tot", metros, widths=widths)
    assert {(r.tract, r.cbsa) for r in dense.collect()} == {("1aa11", "M"), ("1aa12", "M"), ("2bb11", "N")}
    groups = density.compute_block_density(blocks, areas, "job_tot", metros, "M", widths=widths)
    assert {(r.blkgrp, r.cbsa) for r in groups.collect()} == {("1aa11x", "M"), ("1aa12y", "M")}
    assert geo.select_group_units(lehd, "M", metros, widths=widths).count() == 2
    assert {r.state for r in rollup.level_density(lehd, "tract", "state", "job_tot", "ALAND_SQMI", widths=widths).collect()} == {"1", "2"}
    assert rollup.member_totals(blocks, "fips", metros.filter("top100 = 1"), ["year"], widths, jobs="job_tot").first().jobs == 11
    assert {r.stcofips for r in county_counts(blocks, widths).collect()} == {"1aa", "2bb"}
    assert {(r.stcofips, r.stfips) for r in job_places(lehd, widths).collect()} == {("1aa", "1"), ("2bb", "2")}
    pop = lehd.select("tract", F.col("job_tot").alias("pop"))
    assert pop_density(pop, area, metros, widths).filter("cbsa IS NULL").count() == 0
    assert keys.exclude_regions(lehd, "tract", ("1",), widths=widths).count() == 1
    assert keys.universe_filter(lehd, "tract", widths=widths).count() == 3


def test_any_minimum_share_is_itself(spark):
    long = spark.createDataFrame([("t", 4, 1000, "cluster"), ("u", 2, 1000, "cluster")], "tract string, job_tot bigint, metro_total bigint, mapvar string")
    found = {(r.tract, r.pp_min): (r.job_min, r.mapvar) for r in cluster_flags(long, (0.3, 0.25)).collect()}
    assert found[("t", 0.3)] == (3.0, "cluster") and found[("u", 0.3)] == (3.0, "high density") and found[("u", 0.25)][0] == 2.5
    places = spark.createDataFrame([("M", "Metro", 2010, 1000)], "cbsa string, cbsa_name string, year int, job_tot bigint")
    assert {r.pp_min: r.job_min for r in metro_minimums(places, minimums=(0.3, 1.0)).collect()} == {"pp_0_3": 3.0, "one_pp": 10.0}
