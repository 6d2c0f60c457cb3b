"""Packing of documents into fixed-length sequences by exact complements.

Only lengths matter for the plan, and there are at most as many as a sequence has tokens:
the driver gets the number of pieces of each length and nothing else.  For the longest
length left it looks up which single length, pair or triple fills the gap exactly and uses
that combination as often as the counts allow.  Lengths without such a combination are left
to best fit, in bulk by length and gap.  Every step uses up a length or a gap, so the plan has
a few thousand patterns however many documents there are.

Pieces get a rank among those of their length from a running count in each task and the
counts of earlier tasks, so no window gathers a length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import batched, map_arrow, stage, text_column
from tessera.llm.tokens import END_ID, encoder, ids_crc32, tokenizer_path

SEQUENCE = 1024


class Complements:
    """Combinations of available lengths by their sum; lengths below ``least`` are kept back."""

    def __init__(self, counts: np.ndarray, least: int = 1):
        self.counts, self.least = counts, least  # counts[length], changed by the caller

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap >= self.least and self.counts[gap] > 0 else None

    def pair(self, gap: int, longest: int | None = None) -> tuple[int, ...] | None:
        """The pair with the longest first length."""
        first = np.arange(min(gap - self.least, longest or gap), (gap - 1) // 2, -1)
        second = gap - first
        good = (self.counts[first] > 0) & (self.counts[second] > 0) & ((first != second) | (self.counts[first] > 1))
        hit = np.flatnonzero(good)
        return (int(first[hit[0]]), int(second[hit[0]])) if len(hit) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for first in np.flatnonzero(self.counts[: max(gap - 2 * self.least + 1, 0)])[::-1]:
            if 3 * first < gap:
                break
            self.counts[first] -= 1
            rest = self.pair(gap - int(first), int(first))
            self.counts[first] += 1
            if rest:
                return (int(first), *rest)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


Patterns = list[tuple[tuple[int, ...], int]]


def exact_fills(counts: np.ndarray, size: int, least: int, slack: int = 0) -> Patterns:
    """Sequences filled to the last token, or all but ``slack``; what they use is taken from ``counts``."""
    found, out = Complements(counts, least), []
    if counts[size]:
        out.append(((size,), int(counts[size])))
        counts[size] = 0
    for length in range(size - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            gap = size - length
            tries = (found.exact(gap - short) for short in range(min(slack + 1, gap)))
            rest = next((r for r in tries if r), None)
            counts[length] += 1
            if not rest:
                break
            pattern = (length, *rest)
            kinds, times = np.unique(pattern, return_counts=True)
            uses = int((counts[kinds] // times).min())
            counts[kinds] -= uses * times
            out.append((pattern, uses))
    return out


def best_fit(counts: np.ndarray, size: int) -> Patterns:
    """The pieces left, longest first, each into the fullest sequence that has room."""
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            open_at.setdefault(gap, []).append((pattern, n))

    for length in range(size, 0, -1):
        left = int(counts[length])
        for gap in sorted(g for g in open_at if g >= length) if left else ():
            if not left:
                break
            groups, each = open_at.pop(gap), gap // length
            for pattern, n in groups:
                whole = min(n, left // each)
                add(gap - each * length, pattern + (length,) * each, whole)
                left, n = left - whole * each, n - whole
                if n and left:  # fewer than one sequence takes
                    add(gap - left * length, pattern + (length,) * left, 1)
                    left, n = 0, n - 1
                add(gap, pattern, n)
        each = size // length
        add(size - each * length, (length,) * each, left // each)
        if left % each:
            add(size - left % each * length, (length,) * (left % each), 1)
    return [group for groups in open_at.values() for group in groups]


def plan_sequences(pieces: Mapping[int, int], size: int = SEQUENCE) -> Patterns:
    """Patterns (lengths in order) and how often each is used; all pieces are placed.

    Short pieces are worth most at the end, so the plan is made several times, with lengths
    below some bound kept back from the exact fills and a few tokens allowed to stay free,
    and the one with fewest sequences is taken.  The bounds reach from all lengths to none.
    """
    plans = []
    for least, slack in [(1, 0), *itertools.product((size // 8, size // 4), (0, 1, 2, 4, 8)), (size // 2, 0), (size + 1, 0)]:
        counts = np.zeros(size + 1, np.int64)
        for length, n in pieces.items():
            counts[length] = n
        plans.append(exact_fills(counts, size, max(least, 1), slack) + best_fit(counts, size))
    return min(plans, key=lambda plan: sum(n for _, n in plan))


class Placement:
    """Where the piece with a given rank among those of its length goes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], size: int = SEQUENCE):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        used, first = np.zeros(size + 1, np.int64), 0
        for pattern, times in patterns:
            offset = 0
            for length in sorted(set(pattern), reverse=True):
                copies = pattern.count(length)
                slots.setdefault(length, []).append((int(used[length]), first, offset, copies))
                used[length] += copies * times
                offset += copies * length
            first += times
        self.slots = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            starts, firsts, offsets, copies = self.slots[int(size)]
            slot = np.searchsorted(starts, rank[at], "right") - 1
            within = rank[at] - starts[slot]
            sequence[at] = firsts[slot] + within // copies[slot]
            offset[at] = offsets[slot] + within % copies[slot] * size
        return sequence, offset


def cut(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces; only the first may be shorter than ``size``."""
    if n <= size:
        return np.zeros(1, np.int64), np.array([n], np.int64)
    first = n % size or size
    starts = np.concatenate([[0], np.arange(first, n, size)])
    return starts, np.diff(np.append(starts, n))


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    size: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text is one piece that holds the end id.  Rows with the same or with no
    doc_id are packed each for itself; other columns are not read; an empty table gives no row.
    """
    tokenizer = tokenizer or tokenizer_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batched(batches):
            columns: list[list[int | None]] = [[] for _ in range(6)]
            for key, ids in zip(
                batch.column(0).to_pylist(), encode.closed(batch.column(1).to_pylist(), end_id), strict=True
            ):
                for number, (start, length) in enumerate(zip(*cut(len(ids), size), strict=True)):
                    row = (key, number, start, length, ids_crc32(ids[start : start + length]), seen[length])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    seen[length] += 1
            key, number, start, length, crc, rank = columns
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array([part] * len(key), pa.int32()), pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    staged = stage(map_arrow(rows, pieces, f"{schema}, part int, rank long"), "pieces")
    per_task = staged.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = Placement(plan_sequences(histogram, size), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = placement.place(batch.column("length").to_numpy(), rank)
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"]
            )

    return map_arrow(staged.join(base, ["part", "length"]), place, f"{schema}, sequence_id long, offset long")
