from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions import columns as cols
from tessera.functions import keys, sectors


def test_pad_code_never_truncates(spark, rows):
    df = spark.createDataFrame([("7",), ("007",), ("1234567",), ("a b",), (None,)], "c string")
    padded = df.select(keys.pad_code(F.col("c"), 4).alias("p"))
    assert rows(padded) == [(None,), ("0007",), ("0007",), ("0a0b",), ("1234567",)]


def test_default_width_is_the_longest(spark, rows):
    df = spark.createDataFrame([("7",), ("1234",)], "c string")
    assert rows(keys.with_padded(df, "c")) == [("0007",), ("1234",)]


def test_levels_are_prefixes(spark):
    df = spark.createDataFrame([("240054001001000",)], "fips string")
    row = keys.with_levels(df, "fips").first()
    assert (row.state, row.county, row.tract, row.blkgrp) == (
        "24", "24005", "24005400100", "240054001001",
    )


def test_compose_block_key(spark, rows):
    df = spark.createDataFrame(
        [("24005", 4001.01, "7"), ("24005", 12.0, "1234"), ("24005", 12.29, "5")],
        "county string, tract double, block string",
    )
    found = rows(keys.compose_block_key(df, "county", "tract", "block"), "fips")
    assert found == [("240050012001234",), ("240050012290005",), ("240054001010007",)]


def test_short_name(spark, rows):
    names = ["Baltimore-Columbia-Towson, MD", "Akron, OH", "", "-x", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = df.select("n", keys.short_name(F.col("n")).alias("s"))
    assert rows(found) == [
        (None, None), ("", ""), ("-x", "-x"), ("Akron, OH", "Akron, OH"),
        ("Baltimore-Columbia-Towson, MD", "Baltimore"),
    ]


def test_excluding_keeps_missing_ids(spark, rows):
    df = spark.createDataFrame(
        [("25001", "1"), ("24001", "14460"), ("24002", None), (None, "2"), ("24003", "3")],
        "tract string, cbsa string",
    )
    kept = keys.exclude_regions(df, "tract", ("25", "56"), ("14460",))
    assert rows(kept) == [(None, "2"), ("24002", None), ("24003", "3")]


def test_universe(spark, rows):
    df = spark.createDataFrame([(c,) for c in ("01001", "02001", "15001", "56001", "72001", "xx001")], "g string")
    assert rows(keys.universe_filter(df, "g", "stcofips")) == [("01001",), ("56001",)]
    assert keys.universe_filter(df, "g", "stcofips").columns == ["stcofips"]


def test_ratio_follows_floating_point_not_ansi(spark):
    df = spark.createDataFrame(
        [(10, 5.0), (3, 0.0), (0, 0.0), (4, None), (None, 2.0), (-3, 0.0)], "x bigint, a double"
    )
    found = [r[0] for r in df.select(cols.ratio("x", "a")).collect()]
    assert found == [2.0, math.inf, None, None, None, -math.inf]


def test_families(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "id int, naics_11 int, naics_21 int, `1996` int, `2001` int")
    assert cols.sector_columns(df) == ["naics_11", "naics_21"]
    assert cols.family(df, contains="_2") == ["naics_21"]
    named = cols.prefix_numbered(df, 1990, 2000)
    assert named.columns == ["id", "naics_11", "naics_21", "y1996", "2001"]
    assert cols.select_family(named, first=["id"], numbered=("y", 1996, 1999)).columns == ["id", "y1996"]
    assert cols.select_family(named, prefix="naics", rest=True, drop=["id"]).columns == [
        "naics_11", "naics_21", "y1996", "2001",
    ]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`2010` int, `Job Share` int, `% of jobs` int")
    assert cols.clean_names(df).columns == ["x2010", "job_share", "percent_of_jobs"]


def test_sector_labels(spark, rows):
    df = spark.createDataFrame([(code, 1) for code in [*fv.SECTOR_LABELS, "naics_GV"]], "naics string, n int")
    beside = sectors.sector_label(df, new_column=True)
    assert beside.columns == ["naics", "naics_label", "n"]
    assert {r.naics: r.naics_label for r in beside.collect()} == {**fv.SECTOR_LABELS, "naics_GV": None}
    assert {r.naics for r in sectors.sector_label(df).collect()} == {*fv.SECTOR_LABELS.values(), None}


def test_harmonised_codes(spark, rows):
    codes = ["naics_31to33", "naics_44to45", "naics_48to49", "naics_92", "naics_51", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(sectors.harmonise_sector(F.col("c"))).collect()] == [
        "naics_MF", "naics_RT", "naics_RW", "naics_GV", "naics_51", None,
    ]


def test_second_source_codes(spark):
    df = spark.createDataFrame([("REGVL",), ("REGVF",), ("REMF",), ("RE22",)], "i string")
    assert [r[0] for r in df.select(sectors.second_source_sector(F.col("i"))).collect()] == [
        "naics_GV", "naics_GV", "naics_MF", "naics_22",
    ]


def test_split_drops_surplus_and_fills_missing(spark):
    df = spark.createDataFrame([("RE11AXAC",), ("RETA",), ("REAbAcAd",), ("X",)], "DBcode string")
    assert [tuple(r) for r in sectors.split_id(df, "DBcode").collect()] == [
        ("RE11", "X", "C"), ("RET", "", None), ("RE", "b", "c"), ("X", None, None),
    ]
