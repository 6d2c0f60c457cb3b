"""Files, stages, and the shape of the physical plans."""

from __future__ import annotations

import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import ranking
from tessera.operators.ranking import rank_rows
from tessera.plans import queries as q
from tessera.plans.atlas import Atlas
from tessera.sources import files, schemas, staging
from tessera.sources.star import LEVELS, TABLES, Star, in_years
from tests.compare import plan_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
need_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_tsv_keeps_leading_zeros(spark, rows, tmp_path):
    (tmp_path / "area.txt").write_text("GEOID\tALAND_SQMI\n01001020100\t3.788\n1001020200\t\n")
    area = files.read_area(spark, str(tmp_path / "area.txt"))
    assert rows(area) == [("01001020100", 3.788, "01001"), ("01001020200", None, "01001")]
    counties = files.read_area(spark, str(tmp_path / "area.txt"), level="county")
    assert counties.columns[0] == "stcofips"


def test_tsv_columns_are_found_by_name(spark, rows, tmp_path):
    folder = tmp_path / "area"
    folder.mkdir()
    header = "USPS\tGEOID\tALAND\tAWATER\tALAND_SQMI\tINTPTLONG   \n"
    (folder / "a.txt").write_text(header + "AL\t1001020100\t9825304\t0\t3.788\t-86.5 \n")
    (folder / "b.txt").write_text(header + "AL\t01001020200\t3320818\t5669\tbad\t-86.4\n")
    assert rows(files.read_area(spark, str(folder))) == [
        ("01001020100", 3.788, "01001"), ("01001020200", None, "01001")]
    (tmp_path / "swapped.txt").write_text("ALAND_SQMI\tGEOID\n1.5\t01001020100\n")
    assert rows(files.read_area(spark, str(tmp_path / "swapped.txt"))) == [("01001020100", 1.5, "01001")]
    (tmp_path / "short.txt").write_text("GEOID\tALAND\n01001020100\t5\n")
    with pytest.raises(ValueError, match="ALAND_SQMI"):
        files.read_area(spark, str(tmp_path / "short.txt"))


@pytest.mark.parametrize("name", ["CROSSWALK", "CENTRES", "POPULATION", "BLOCK_AREA", "COUNTS"])
def test_every_flat_input_has_a_reader(spark, tmp_path, name):
    schema = getattr(schemas, name)
    values = {"string": "01", "int": 7, "bigint": 12345678901, "double": 2.5}
    row = tuple(values[f.dataType.simpleString()] for f in schema.fields)
    df = spark.createDataFrame([row, (None,) * len(row)], schema)
    turned = df.select("*", F.lit("x").alias("other")).select(*reversed([*df.columns, "other"]))
    turned.write.option("sep", "\t").option("header", True).csv(str(tmp_path / name))
    read = files.read_tsv(spark, str(tmp_path / name), schema)
    assert read.schema == schema and set(map(tuple, read.collect())) == {row, (None,) * len(row)}


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.txt").write_text("GEOID\tALAND_SQMI\n01001020100\t1.5\n")
    (folder / "b.txt").write_text("ALAND_SQMI\tGEOID\n2.5\t01001020200\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_area(spark, str(folder)).collect()


def test_csv_writes_missing_as_blank(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), (None, None, 2.5)], "k string, n int, v double").coalesce(1)
    files.export_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert sorted(text.split()) == [",,2.5", "a,1,", "k,n,v"]


def test_stack_fills_absent_columns(spark, rows):
    first = spark.createDataFrame([("a", 1)], "k string, n int")
    second = spark.createDataFrame([("b", 2, 3)], "k string, n int, extra int")
    stacked = files.stack_periods({2010: first, 2015: second})
    assert rows(stacked, "k", "n", "year", "extra") == [("a", 1, 2010, None), ("b", 2, 2015, 3)]
    assert "year" not in files.stack_periods({"01": first, "02": second}, tag=None).columns


def test_kept_stage_prunes_by_year(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 2010, 1), ("b", 2015, 2)], "tract string, year int, n int")
    path = str(tmp_path / "kept")
    staging.save_stage(df, path)
    kept = staging.load_stage(spark, path, df.schema)
    assert kept.columns == df.columns
    assert rows(kept.filter("year = 2015")) == [("b", 2015, 2)]
    assert "PartitionFilters: [isnotnull(year" in plan_of(kept.filter("year = 2015"))


def test_stages_use_the_named_folder(spark, tmp_path, monkeypatch):
    folder = staging.shared_folder(spark)
    assert folder and staging.new_path(spark, "x").startswith(folder.rstrip("/"))

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs://shared/checkpoints/"

    assert staging.new_path(Session(), "x").startswith("hdfs://shared/checkpoints/x-")


def test_a_scope_deletes_its_tables(spark):
    folder = Path(staging.shared_folder(spark).removeprefix("file:"))
    folder.mkdir(parents=True, exist_ok=True)
    before = set(os.listdir(folder))
    with staging.StageScope(spark):
        outer = staging.stage(spark.range(3).toDF("a"), "outer")
        with staging.StageScope(spark):
            assert rank_rows(outer, [], "a", ["a"]).count() == 3
        assert len(set(os.listdir(folder)) - before) == 1 and outer.count() == 3
    assert set(os.listdir(folder)) == before


def test_no_folder_on_a_cluster_is_an_error():
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session())


def test_schemas_have_text_keys():
    assert schemas.COUNTS["fips"].dataType.simpleString() == "string"
    assert len(schemas.COUNTS) == 22


def test_ranking_orders_no_whole_group_in_one_task(spark):
    df = spark.range(100).selectExpr("id AS u", "'g' AS g", "CAST(id AS DOUBLE) AS v")
    plan = plan_of(rank_rows(df, ["g"], "v", ["u"]))
    assert "Window" not in plan and "BroadcastHashJoin" in plan


@need_tables
def test_scans_read_few_columns_and_push_filters(spark):
    plan = plan_of(Atlas(spark, SF_DIR, q.PARAMS).lehd((1997,), ["job_tot"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan
    shipped = plan_of(Star(spark, SF_DIR).emp((1997,)))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in shipped


@need_tables
@pytest.mark.parametrize("name,years,metros", [
    ("national_two_year", {1996, 1997}, None), ("location_quotient", {1996, 1997}, None), ("metro_two_year", {1996, 1997}, None),
    ("industry_cluster_shares", {1996, 1997}, None), ("thresholds_full_join", {1996, 1997}, None),
    ("cluster_view", {1997}, {"M1"}), ("overview_table", {1997}, {"M1"}), ("describe_metro", {1997}, {"M1"}),
])
def test_only_wanted_rows_are_ranked(spark, monkeypatch, name, years, metros):
    staged, keep = [], ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, label: staged.append(keep(df, label)) or staged[-1])
    q.QUERIES[name](spark, SF_DIR)
    assert len(staged) == 1
    found = staged[0].select("year", "cbsa").distinct().collect()
    assert {r["year"] for r in found} == years
    assert metros is None or {r["cbsa"] for r in found} == metros


def test_years_become_ranges():
    text = in_years("d", (1997, 1996, 1999))
    assert text.count("d >=") == 2 and "'1996-01-01' AND d < timestamp_ntz'1998-01-01'" in text


def test_wide_place_keys_stay_apart(spark, tmp_path):
    customers = [*range(1, 20), 999_999, *(1_000_000 + 9_999_991 * k for k in range(40)), 2**63 - 1]
    orders = [(10**7 * k + j, customers[k % len(customers)]) for k in range(300) for j in (1, 2, 15)]
    spark.createDataFrame([(c, f"c{c}", c % 25, float(c % 900), "x") for c in customers], TABLES["customer"]).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, f"n{n}", n % 5) for n in range(25)], TABLES["nation"]).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "p", "b", "PROMO", 5, 1.0)], TABLES["part"]).write.parquet(f"{tmp_path}/part.parquet")
    day = datetime(1997, 5, 5)
    spark.createDataFrame([(o, c, "O", 1e5, day, "1") for o, c in orders], TABLES["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o, 1, 1, 1, 2.0, 1.0, 0.0, 0.0, "N", "O", day) for o, _ in orders], TABLES["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    star = Star(spark, str(tmp_path))
    assert star.area().count() == len(customers)
    for counts in (star.wac(), star.wac((1997,))):
        levels = keys.with_levels(counts, "fips", widths=LEVELS)
        assert counts.count() == counts.select("fips").distinct().count() == len(orders)
        assert levels.select("tract").distinct().count() == len(customers)
        assert len(customers) < levels.select("blkgrp").distinct().count() < len(orders)
        assert {len(r["fips"]) for r in counts.collect()} == {44}
