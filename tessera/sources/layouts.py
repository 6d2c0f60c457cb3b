"""Tables laid out for the joins and filters that follow: buckets of a key, and order in space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 16  # bits of each coordinate in the order of space


def save_buckets(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Keep ``df`` as a table of sorted buckets of ``key``, one file each, and read it.

    Tables with the same number of buckets of one key are joined, and sums by that key taken,
    without moving a row.  A key's rows are all in one bucket: sums stream over it, but a key
    that holds a third of all rows makes one long task, so add up what can be added before.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget the name of a kept table; its files stay until their folder is deleted."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def _spread(cell: Column) -> Column:
    """The bits of a number below 2^16, with a gap after each."""
    out = cell
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def space_key(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Place on the Z-shaped curve through a box (west, south, east, north), which keeps neighbours close."""
    west, south, east, north = box

    def cell(value: Column, low: float, high: float) -> Column:
        share = (value - low) / (high - low) if high > low else F.lit(0.0)
        return F.greatest(F.least(F.floor(share * (1 << CELLS)), F.lit((1 << CELLS) - 1)), F.lit(0)).cast("long")

    return _spread(cell(x, west, east)).bitwiseOR(F.shiftleft(_spread(cell(y, south, north)), 1))


def with_extent(bounds: DataFrame, rings: str = "rings") -> DataFrame:
    """Adds west, south, east and north of each boundary."""
    ends = {"west": "array_min lon", "east": "array_max lon", "south": "array_min lat", "north": "array_max lat"}
    return bounds.withColumns(
        {
            name: F.expr(f"{rule.split()[0]}(transform(flatten(`{rings}`), p -> p.{rule.split()[1]}))")
            for name, rule in ends.items()
        }
    )


def save_layer(bounds: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Keep a layer in the order of space, so that the extents of a file or row group are small.

    Parquet keeps the least and greatest west, east, south and north of each, and a window's
    filters skip all that lie outside it.
    """
    extent = with_extent(bounds)
    west, south, east, north, n = extent.agg(F.min("west"), F.min("south"), F.max("east"), F.max("north"), F.count("*")).first()
    if not n or west is None:
        extent.write.mode("overwrite").parquet(path)
        return
    key = space_key((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2, (west, south, east, north))
    placed = extent.withColumn("_z", key)
    order = [F.col("_z"), F.xxhash64("geoid")]
    placed.repartitionByRange(max(-(-n // rows_per_file), 1), *order).sortWithinPartitions(*order).drop("_z").write.mode(
        "overwrite"
    ).parquet(path)


def in_window(layer: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Boundaries whose extent meets the window; the four filters reach the scan."""
    return layer.filter(
        (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    )
