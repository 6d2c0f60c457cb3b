"""Kept stages brought up to date period by period.

A stage is kept with one directory per period and a manifest of the versions of what each
period was made from.  A refresh rebuilds only periods whose version is new or has changed, in
one job that overwrites just their directories, and drops periods that are gone.  The
manifest is written last: if a refresh breaks off, what it touched is rebuilt by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_version(spark: SparkSession, *paths: str) -> str:
    """A text that changes when a file below ``paths`` is added, removed, replaced or changed.

    Names, sizes and times are listed by Spark; no content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    total = found.select(mark.alias("mark")).agg(F.expr("bit_xor(mark)"), F.count("*"))
    mixed, files = total.first()
    return f"{(mixed or 0) & (1 << 64) - 1:016x}-{files}"


class KeptStage:
    """A table under ``path``, partitioned by ``period``, with its manifest beside the data."""

    def __init__(self, spark: SparkSession, path: str, period: str = "year"):
        self.spark, self.path, self.period = spark, path.rstrip("/"), period

    def _file_system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _manifests(self) -> list[tuple[int, str]]:
        """Complete manifests, oldest first."""
        folder = f"{self.path}/_manifest"
        system, place = self._file_system(folder)
        if not system.exists(place):
            return []
        found = []
        for entry in system.listStatus(place):
            name = entry.getPath().getName()
            _, done = self._file_system(f"{folder}/{name}/_SUCCESS")
            if name.isdigit() and system.exists(done):
                found.append((int(name), f"{folder}/{name}"))
        return sorted(found)

    def versions(self) -> dict[str, str]:
        """Version of each kept period, by the last complete manifest."""
        manifests = self._manifests()
        if not manifests:
            return {}
        rows = self.spark.read.schema("period string, version string").parquet(manifests[-1][1]).collect()
        return {r["period"]: r["version"] for r in rows}

    def refresh(self, versions: Mapping[object, str], build: Callable[[list], DataFrame]) -> list:
        """Bring the stage to ``versions`` and return the periods that were rebuilt.

        ``build`` is given the changed periods and returns their rows with the period column.
        A period without rows loses its directory.
        """
        kept = self.versions()
        changed = [p for p, version in versions.items() if kept.get(str(p)) != version]
        gone = sorted(set(kept) - {str(p) for p in versions})
        if not changed and not gone:
            return []
        if kept:  # until the end, what is touched counts as not kept
            self._write({p: v for p, v in kept.items() if p not in {str(c) for c in changed} and p not in gone})
        for period in [*gone, *map(str, changed)]:
            system, place = self._file_system(f"{self.path}/{self.period}={period}")
            system.delete(place, True)
        if changed:
            rows = build(changed)
            rows.hint("rebalance", self.period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                self.period
            ).parquet(self.path)
        self._write({str(p): version for p, version in versions.items()})
        return changed

    def _write(self, versions: Mapping[str, str]) -> None:
        manifests = self._manifests()
        number = manifests[-1][0] + 1 if manifests else 0
        rows = self.spark.createDataFrame(list(versions.items()), "period string, version string")
        rows.write.mode("overwrite").parquet(f"{self.path}/_manifest/{number}")
        for _, old in manifests:
            system, place = self._file_system(old)
            system.delete(place, True)

    def read(self, schema) -> DataFrame:
        names = [f.name for f in schema.fields]
        return self.spark.read.schema(schema).parquet(self.path).select(*names)


def keep_once(spark: SparkSession, folder: str, build: Callable[[str], None]) -> str:
    """``folder``, filled by ``build`` if it is not there yet.

    It is built under another name and renamed when it is whole, so a folder that exists is
    complete; where two sessions build at once, the first one's stays.
    """
    stage = KeptStage(spark, folder)
    system, place = stage._file_system(folder)
    if not system.exists(place):
        work = f"{folder}-{uuid.uuid4().hex}"
        build(work)
        source = stage._file_system(work)[1]
        if system.exists(place) or not system.rename(source, place):
            system.delete(source, True)
    return folder
