"""Delimited files in and out, and stacking of multi-part inputs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as fv
from tessera.functions.keys import level_key, with_padded
from tessera.sources import schemas


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` from headed, tab-separated files, found by their names.

    The files may have other columns and any order.  All are read as text by the header,
    which has to be the same in every file; the wanted ones are cast, and what does not fit
    its type is NULL.  A missing column is an error.
    """
    options = {"sep": "\t", "header": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    header = spark.read.options(**options).csv(path).columns
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = spark.read.schema(as_text).options(**options, enforceSchema="false").csv(path)
    named = {name.strip().lower(): name for name in header}
    missing = [f.name for f in schema.fields if f.name.lower() not in named]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return rows.select(
        *[F.col(f"`{named[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


#: A cell that does not fit, or a line with too few or too many cells (column and expected are then NULL).
PROBLEMS = "file string, row bigint, column string, expected string, raw string"


def scan_tsv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_tsv`, with a table of what did not fit: file, row, column, expected, raw.

    Rows are counted from 1 in each file, below its header.  A file may be read in pieces:
    these are counted first, and a row's number is its place in the piece and all rows before it.
    """
    options = {"sep": "\t", "header": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    header = spark.read.options(**options).csv(path).columns
    named = {name.strip().lower(): name for name in header}
    missing = [f.name for f in schema.fields if f.name.lower() not in named]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in [*header, "_line"]])
    lines = (
        spark.read.schema(as_text).options(**options, enforceSchema="false", columnNameOfCorruptRecord="_line").csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_id"))
    )
    cells = [(f, F.col(f"`{named[f.name.lower()]}`")) for f in schema.fields]
    rows = lines.select(*[cell.try_cast(f.dataType).alias(f.name) for f, cell in cells])

    none = F.lit(None).cast("string")
    wrong = [
        F.when(cell.isNotNull() & cell.try_cast(f.dataType).isNull(),
               F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("expected"), cell.alias("raw")))
        for f, cell in cells
    ]
    broken = F.when(F.col("_line").isNotNull(), F.struct(none.alias("column"), none.alias("expected"), F.col("_line").alias("raw")))
    found = lines.select("_file", "_start", "_id", F.explode(F.array_compact(F.array(*wrong, broken))).alias("p"))
    pieces = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn(
        "_before", F.expr("coalesce(sum(_n) OVER (PARTITION BY _file ORDER BY _start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    )
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    problems = found.join(pieces, ["_file", "_start"]).select(
        F.element_at(F.split("_file", "/"), -1).alias("file"), number.alias("row"), "p.column", "p.expected", "p.raw"
    )
    return rows, problems


def read_area(
    spark: SparkSession, path: str, level: str = "tract", schema=schemas.AREA, widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    """Land area file: key as text, padded to the widest key, county beside it."""
    area = read_tsv(spark, path, schema)
    if level == "county":
        return area.withColumnRenamed("GEOID", "stcofips")
    padded = with_padded(area, "GEOID").withColumnRenamed("GEOID", level)
    return padded.withColumn("stcofips", level_key(F.col(level), "county", widths))


def export_csv(df: DataFrame, path: str) -> None:
    """Result table as headed CSV, missing values blank."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def stack_periods(
    parts: Mapping[object, DataFrame], tag: str | None = "year", tag_type: str = "int"
) -> DataFrame:
    """Union by name of the parts, each tagged with its key; absent columns are NULL."""

    def tagged(key, part):
        value: Column = F.lit(key).cast(tag_type)
        return part.withColumn(tag, value) if tag else part

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [tagged(key, part) for key, part in parts.items()],
    )
