"""Partial results that are kept small and merged: moments of pairs of values, and sets of units.

Moments per fine group (say county and year) are counts, means and centred sums.  Coarser groups
merge them without the rows, and without the loss that sums of squares have where values are
large and close.  Sets of numbered units are kept as bitmaps per period; the units of any set of
periods are counted by joining bits, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import join_nullsafe
from tessera.sources.staging import stage

MOMENTS = ("n", "mean_x", "mean_y", "m2_x", "m2_y", "c_xy", "min_x", "max_x")


def partial_moments(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Count, means, centred second moments and co-moment of the rows that have both values."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    n = F.count(a)
    held = df.groupBy(*by).agg(
        n.alias("n"), F.avg(a).alias("mean_x"), F.avg(b).alias("mean_y"), (F.var_pop(a) * n).alias("m2_x"),
        (F.var_pop(b) * n).alias("m2_y"), (F.covar_pop(a, b) * n).alias("c_xy"), F.min(a).alias("min_x"), F.max(a).alias("max_x"),
    )
    return held.filter("n > 0")


def merge_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same columns for coarser groups: what lies between the parts' means is added to what lies inside them.

    Means are merged around one of them, so digits that all share are never squared or summed.
    """
    if not by:
        return merge_moments(moments.withColumn("_whole", F.lit(0)), ["_whole"]).drop("_whole")
    start = moments.groupBy(*by).agg(F.min("mean_x").alias("_x"), F.min("mean_y").alias("_y"))
    near = join_nullsafe(moments, start, by, "inner")
    shifted = near.groupBy(*by, "_x", "_y").agg(
        F.sum("n").alias("_n"), F.expr("sum(n * (mean_x - _x)) / sum(n) AS _dx"), F.expr("sum(n * (mean_y - _y)) / sum(n) AS _dy")
    )
    apart = join_nullsafe(near.drop("_x", "_y"), shifted, by, "inner")
    gaps = {"_gx": F.expr("mean_x - _x - _dx"), "_gy": F.expr("mean_y - _y - _dy")}
    return apart.withColumns(gaps).groupBy(*by).agg(
        F.sum("n").alias("n"), F.expr("max(_x + _dx) AS mean_x"), F.expr("max(_y + _dy) AS mean_y"),
        F.expr("sum(m2_x + n * _gx * _gx) AS m2_x"), F.expr("sum(m2_y + n * _gy * _gy) AS m2_y"),
        F.expr("sum(c_xy + n * _gx * _gy) AS c_xy"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
    )


def describe_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size, mean, spread, correlation and least-squares line (y on x) from moments."""
    slope = "try_divide(c_xy, m2_x)"
    return moments.selectExpr(
        *[f"`{g}`" for g in by], "n", "mean_x AS mean", "CASE WHEN n > 1 THEN sqrt(m2_x / (n - 1)) END AS sd", "min_x AS min",
        "max_x AS max", "try_divide(c_xy, sqrt(m2_x) * sqrt(m2_y)) AS correlation", f"{slope} AS slope",
        f"mean_y - {slope} * mean_x AS intercept",
    )


# --- sets of units ------------------------------------------------------------------------------


def number_units(df: DataFrame, unit: str, known: DataFrame | None = None) -> DataFrame:
    """unit, id: a number for every distinct unit; those in ``known`` keep theirs, new ones go on after them.

    Numbers leave gaps between tasks, which bitmaps do not mind.
    """
    units = df.filter(F.col(unit).isNotNull()).select(unit).distinct()
    if known is None:
        return stage(units.withColumn("id", F.monotonically_increasing_id() + 1), "units")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = units.join(known, unit, "left_anti").withColumn("id", F.monotonically_increasing_id() + 1 + F.lit(last))
    return stage(known.select(unit, "id").unionByName(fresh), "units")


def unit_sets(df: DataFrame, unit: str, numbers: DataFrame, by: Sequence[str]) -> DataFrame:
    """The units of each group as bitmaps of 32,768 numbers: by, bucket, units."""
    numbered = df.join(numbers, unit)
    return numbered.groupBy(*by, F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("units")
    )


def count_units(sets: DataFrame, by: Sequence[str], name: str = "units") -> DataFrame:
    """How many different units there are in coarser groups, over any periods that ``sets`` is cut down to."""
    joined = sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("units").alias("_bits"))
    return joined.groupBy(*by).agg(F.sum(F.bitmap_count("_bits")).alias(name))
