"""Attribute joins to boundary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.keys import level_key
from tessera.operators.joins import members


def select_group_units(
    df: DataFrame, cbsa: str, crosswalk: DataFrame, unit: str = "tract", widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    """Places whose county belongs to one metro."""
    counties = crosswalk.filter(F.col("cbsa") == cbsa)
    keyed = df.withColumn("_cty", level_key(F.col(unit), "county", widths))
    return members(keyed, "_cty", counties, "stcofips").drop("_cty")


def geo_attribute_join(
    units: DataFrame,
    bounds: DataFrame,
    unit: str = "tract",
    columns: Sequence[str] = ("job_tot", "density", "ALAND_SQMI"),
    families: Sequence[str] = ("dense_cat", "most_dense", "mapvar"),
) -> DataFrame:
    """Map layer: boundary rows with the attributes of their place, both required."""
    chosen = [c for c in columns if c in units.columns]
    chosen += [c for c in units.columns if any(f in c for f in families)]
    return bounds.join(
        units.select(F.col(unit).alias("geoid"), F.col(unit), *chosen), "geoid"
    )


def boundary_vertices(bounds: DataFrame, renamed: str = "id") -> DataFrame:
    """One row per vertex: lon, lat, ring, order along the whole boundary."""
    # Sizes of the rings are summed once, before the rings part; no ring carries the others along.
    sizes = F.transform("rings", lambda r: F.greatest(F.size(r), F.lit(0)))
    start = F.array(F.lit(0))
    before = F.aggregate(sizes, start, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    rings = bounds.withColumn("_starts", before).select(
        "geoid", F.posexplode(F.arrays_zip(F.col("rings").alias("ring"), F.slice("_starts", 1, F.size("rings")).alias("start")))
        .alias("ring", "_ring"),
    )
    points = rings.select(
        "geoid", "ring", F.col("_ring.start").alias("_before"), F.posexplode("_ring.ring").alias("_k", "_point")
    )
    return points.select(
        F.col("_point.lon").alias("long"),
        F.col("_point.lat").alias("lat"),
        (F.col("_before") + F.col("_k") + 1).alias("order"),
        (F.col("ring") + 1).alias("ring"),
        F.col("geoid").alias(renamed),
    )


def choropleth_rows(
    vertices: DataFrame, dense: DataFrame, key: str = "stcofips", measure: str = "jobs_sqmi"
) -> DataFrame:
    """County vertices with what fills the county; others stay unfilled.

    ``dense`` is summed first: one row per county and year with the number of its dense
    places and their largest density.  Vertices times places, all pairs within a county,
    are never written out; the places themselves stay in the ``dense`` table.
    """
    fill = dense.groupBy(key, "year").agg(
        F.count("*").alias("dense_places"), F.max(measure).alias(f"top_{measure}")
    )
    return vertices.join(fill, key, "left")
