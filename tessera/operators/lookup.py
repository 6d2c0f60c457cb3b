"""Crosswalk subsets, retired codes and coordinate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.keys import outside
from tessera.sources.staging import stage


def remap_codes(df: DataFrame, key: str, remap: DataFrame) -> DataFrame:
    """Replace retired codes using an ``(old, new)`` table.

    Run it before a roll-up so that codes that merge are summed together.
    """
    joined = df.join(remap.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
    return joined.withColumn(key, F.coalesce("_new", key)).drop("_new").select(*df.columns)


def resolve_codes(remap: DataFrame) -> DataFrame:
    """Retired codes followed to codes in use: old, new, num, den (the part num / den of the old count).

    ``remap`` has old, new and, where a code splits, weight (whole numbers; default 1).  A
    code that merges or is renamed has one row, one that splits has several; new codes may be
    retired again.  Every round doubles how far a path reaches, so chains of n codes take
    log2(n) joins.  A circle never ends and is an error.
    """
    weight = F.col("weight").cast("long") if "weight" in remap.columns else F.lit(1).cast("long")
    hops = remap.select("old", "new", weight.alias("num")).filter("old IS NOT NULL AND new IS NOT NULL AND num > 0")
    sums = hops.groupBy("old").agg(F.sum("num").alias("den"))
    paths = stage(hops.join(sums, "old").select("old", "new", "num", "den"), "codes")
    # No path is longer than there are retired codes.
    for _ in range(sums.count().bit_length() + 1):
        further = paths.select(F.col("old").alias("new"), F.col("new").alias("_to"), F.col("num").alias("_num"), F.col("den").alias("_den"))
        open_paths = paths.join(further.select("new").distinct(), "new", "left_semi")
        if open_paths.isEmpty():
            return paths
        if not paths.filter("old = new").isEmpty():
            break
        moved = paths.join(further, "new", "left").select(
            "old", F.coalesce("_to", "new").alias("new"), F.expr("num * coalesce(_num, 1) AS num"), F.expr("den * coalesce(_den, 1) AS den")
        )
        paths = stage(moved, "codes")
    raise ValueError("retired codes form a circle")


def split_codes(df: DataFrame, key: str, remap: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Rows under codes in use: a count goes to its new codes by largest remainder, so totals stay.

    Whole counts are divided by weight and rounded down; what is left goes one by one to the
    parts that lost most, equal ones in the order of their codes.  A missing count stays
    missing, a negative one is divided like its positive.  Run it before a roll-up, so that codes
    that merge are summed.
    """
    part = F.struct("new", "num", "den")
    parts = resolve_codes(remap).groupBy(F.col("old").alias(key)).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    joined = df.join(parts, key, "left")
    one = f"array(named_struct('new', `{key}`, 'num', 1L, 'den', 1L))"
    split = joined.withColumn("_parts", F.expr(f"coalesce(_parts, {one})"))
    for i, measure in enumerate(measures):
        size = f"abs(CAST(`{measure}` AS BIGINT))"
        floors = f"transform(_parts, p -> {size} * p.num DIV p.den)"
        left = f"{size} - aggregate({floors}, 0L, (a, x) -> a + x)"
        lost = f"transform(_parts, (p, i) -> struct(-CAST({size} * p.num % p.den AS DOUBLE) / p.den AS lost, i))"
        split = split.withColumns({f"_floor{i}": F.expr(floors), f"_order{i}": F.expr(f"transform(array_sort({lost}), x -> x.i)")})
        split = split.withColumn(f"_left{i}", F.expr(left))
        more = f"CASE WHEN array_position(_order{i}, k) <= _left{i} THEN 1 ELSE 0 END"
        split = split.withColumn(f"_share{i}", F.expr(f"transform(_floor{i}, (x, k) -> sign(`{measure}`) * (x + {more}))"))
    taken = [
        f"CAST(_share{measures.index(c)}[_at] AS BIGINT) AS `{c}`" if c in measures else "_part.new AS `" + c + "`" if c == key else f"`{c}`"
        for c in df.columns
    ]
    return split.select("*", F.posexplode("_parts").alias("_at", "_part")).selectExpr(*taken)


def metro_counties(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.filter(F.col("metro_micro") == fv.METROPOLITAN)


def top_counties(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.filter(F.col("top100") == 1).select("cbsa", "cbsa_name", "stcofips")


def top_metros(crosswalk: DataFrame, excluded=()) -> DataFrame:
    """Distinct top metros without the excluded ones."""
    metros = top_counties(crosswalk).select("cbsa", "cbsa_name").distinct()
    return metros.filter(outside(F.col("cbsa"), excluded))


def coords_backfill(centres: DataFrame, found: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fill missing centres (0/0 or no latitude), then apply overrides by id.

    ``found`` and ``overrides`` hold ``cbsa, lat, lon``.
    """
    lat, lon = F.col("lat"), F.col("lon")
    missing = ((lat == 0) & (lon == 0)) | lat.isNull()
    searched = found.select("cbsa", F.col("lat").alias("_flat"), F.col("lon").alias("_flon"))
    by_hand = overrides.select("cbsa", F.col("lat").alias("_olat"), F.col("lon").alias("_olon"))
    joined = centres.join(searched, "cbsa", "left").join(by_hand, "cbsa", "left")
    return joined.withColumns(
        {
            "lat": F.coalesce("_olat", F.when(missing, F.col("_flat")).otherwise(lat)),
            "lon": F.coalesce("_olon", F.when(missing, F.col("_flon")).otherwise(lon)),
        }
    ).select(*centres.columns)


def centre_overrides(df: DataFrame) -> DataFrame:
    """The centres set by hand, as a table in the session of ``df``."""
    return df.sparkSession.createDataFrame(
        list(fv.CENTRE_OVERRIDES), "cbsa string, lat double, lon double"
    )
