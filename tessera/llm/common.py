"""What several of these operators share: tables, words, Arrow helpers, stage life time."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import shared_folder, stage

__all__ = [
    "WordHashes", "batched", "fresh_names", "map_arrow", "ragged_take", "shared_folder", "ship", "stage", "table",
    "tasks", "text_column", "words", "worker_copy",
]

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8_000_000
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context, whatever their own paths are.

    Arrow batches are limited to ``BATCH_BYTES`` unless the session asks for smaller ones: with
    long texts, a limit by rows alone would fill a worker's memory.
    """
    context = spark.sparkContext
    size = spark.conf.get(BATCH_SETTING, f"{BATCH_BYTES}").removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:  # also where it is written with a unit
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}")
    if not getattr(context, "_tessera_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(target)
        context._tessera_shipped = True


_KEPT: dict[str, object] = {}


def worker_copy(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task; one at a time, so that memory stays bounded."""
    if name not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[name] = make()
    return _KEPT[name]


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def tasks(spark: SparkSession) -> int:
    """Into how many parts the session deals shuffled rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D, as UTF-8."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; starts anew when it is full."""

    def __init__(self, seed: int = 0, most: int = 200_000, normal=None):
        super().__init__()
        self.seed, self.most, self.normal = seed, most, normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(self.normal(word) if self.normal else word, self.seed)
        self[word] = value
        return value

    def of(self, found: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def batched(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that long texts are worked on a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has such a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_column(name: str):
    """A column as text; NULL stays NULL."""
    return F.col(f"`{name}`").cast("string")
