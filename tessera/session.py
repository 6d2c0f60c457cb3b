"""A session with the settings the analyses are tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Sizes of joins and of shuffle partitions are settled at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column costs several calls each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int, name: str = "tessera", memory: str = "8g") -> SparkSession:
    """One-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A folder for staged tables of a one-machine session that names none."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        _FOLDERS[application] = tempfile.mkdtemp(prefix="tessera-")
    return _FOLDERS[application]
