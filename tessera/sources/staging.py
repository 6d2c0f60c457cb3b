"""Intermediate tables kept in the cluster's shared folder.

A staged table is written once and read back, which cuts the lineage and lets
several passes over the same rows agree even when executors are lost.  Staging is an
action: a query that stages runs jobs while it is being built.

The folder is the one the cluster names in ``spark.checkpoint.dir`` (or the context's
checkpoint folder); it has to be shared by all executors.  Only a local session without
that setting gets a folder of its own.  Tables stay until they are deleted: inside
``with StageScope(spark):`` all tables staged by this thread are, at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_folder

_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("tessera_stage_scopes", default=())


class StageScope:
    """Life time of staged tables; write or collect the result before the scope ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> StageScope:
        self._token = _SCOPES.set((*_SCOPES.get(), self.paths))
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.reset(self._token)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return scratch_folder(spark)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _SCOPES.get()[-1:]:
        paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",)) -> None:
    """Keep a stage result for later runs, one directory per period.

    The rebalance gathers a period's rows into few files and still splits a period
    that holds most of the rows.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_stage(spark: SparkSession, path: str, schema) -> DataFrame:
    """Reload a kept stage; filters on the partition columns prune directories."""
    names = [f.name for f in schema.fields]
    return spark.read.schema(schema).parquet(path).select(*names)
