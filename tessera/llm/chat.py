"""Chat rendering after collapsing cumulative snapshots.

A log that stores a conversation after every turn holds many prefixes of the same talk.  Each
turn gets a rolling hash of all turns up to it (128 bits in two halves); a conversation whose
last hash is an earlier hash of a longer one is a snapshot and drops out by an anti-join, and
of equal conversations the smallest id stays.  What is left is rendered.

Turns are range-partitioned by (conversation, turn) and hashed in one streaming pass, so a
conversation of any length is spread over many tasks: a table with at most one row per
partition carries the hash on from one to the next.  Rendered text comes in segments of at
most ``SEGMENT_TURNS`` turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, stage, text_column

SEGMENT_TURNS = 256
LOW64 = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two halves
START, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_hash(role: str | None, text: str | None, half: int) -> int:
    """Hash of one turn; a missing role or text differs from an empty one."""
    known = f"{'-' if role is None else '+' + role}\x00{'-' if text is None else '+' + text}"
    return xxhash.xxh64_intdigest(known.encode(), half + 11)


def carry_on(before: tuple[int, int], turns: int, own: tuple[int, int]) -> tuple[int, int]:
    """Hash of a sequence whose first part has hash ``before`` and whose last ``turns`` turns ``own``."""
    return tuple((b * pow(m, turns, LOW64 + 1) + o) & LOW64 for b, m, o in zip(before, BASES, own, strict=True))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def prefix_hashes(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their number ``n`` (from 1) in the conversation and ``h0``, ``h1`` of the prefix that they end."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        text_column(role).alias("role"), text_column(text).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n, h = TaskContext.get().partitionId(), None, 0, (0, 0)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            counts, hashes = [], ([], [])
            for conv, who, what in zip(*columns, strict=True):
                if conv != now:
                    now, n, h = conv, 0, (0, 0)
                n, h = n + 1, carry_on(h, 1, (turn_hash(who, what, 0), turn_hash(who, what, 1)))
                counts.append(n)
                hashes[0].append(h[0])
                hashes[1].append(h[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(counts, pa.int64()),
                 _signed(hashes[0]), _signed(hashes[1])],
                [*batch.schema.names, "part", "n", "h0", "h1"],
            )

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string"
    hashed = f"{schema}, part int, n long, h0 long, h1 long"
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(map_arrow(ordered, local, hashed), "turns")

    # Conversations over several partitions: at most one runs over each partition's edge.
    runs = placed.groupBy("conv_id", "part").agg(F.max_by(F.struct("n", "h0", "h1"), "n").alias("end"))
    divided = runs.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")
    open_runs = runs.join(divided, "conv_id", "left_semi").select("conv_id", "part", "end.*")
    base: dict = {}
    starts: list[tuple] = []
    for r in sorted(open_runs.toLocalIterator(), key=lambda r: (r["conv_id"], r["part"])):
        n, h = base.get(r["conv_id"], (0, (0, 0)))
        starts.append((r["conv_id"], r["part"], n, *(str(x) for x in h)))
        base[r["conv_id"]] = (n + r["n"], carry_on(h, r["n"], (r["h0"] & LOW64, r["h1"] & LOW64)))
    carried = turns.sparkSession.createDataFrame(starts, f"conv_id {kind}, part int, n_base long, b0 string, b1 string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h0, h1, base_n, b0, b1 = (
                batch.column(c).to_pylist() for c in ("n", "h0", "h1", "n_base", "b0", "b1")
            )
            whole, hashes = [], ([], [])
            for own_n, x, y, before_n, p, q in zip(n, h0, h1, base_n, b0, b1, strict=True):
                h = (x & LOW64, y & LOW64)
                if before_n:
                    h = carry_on((int(p), int(q)), own_n, h)
                whole.append(own_n + (before_n or 0))
                hashes[0].append(h[0])
                hashes[1].append(h[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(whole, pa.int64()),
                 _signed(hashes[0]), _signed(hashes[1])],
                ["conv_id", "turn", "role", "text", "n", "h0", "h1"],
            )

    joined = placed.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return map_arrow(joined, finish, f"{schema}, n long, h0 long, h1 long")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no snapshot of a longer one and no repeat."""
    light = stage(prefixes.select("conv_id", "n", "h0", "h1"), "prefixes")
    whole = light.groupBy("conv_id").agg(F.max_by(F.struct("n", "h0", "h1"), "n").alias("end"))
    whole = whole.select("conv_id", "end.*")
    # Equal conversations fold first, so that a very common one is a single row from here on.
    unique = whole.groupBy("n", "h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    lengths = whole.select("conv_id", F.col("n").alias("n_turns"))
    inner = light.join(lengths, "conv_id").filter("n < n_turns").select("n", "h0", "h1").distinct()
    return unique.join(inner, ["n", "h0", "h1"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render_maximal(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """conv_id, n_turns, segment (from 0), segment_turns, rendered: the kept conversations.

    The segments of a conversation, one after another, are its whole rendering; up to
    ``segment_turns`` turns it is a single one.

    Turns are ordered by ``turn`` (NULL last), then by role and a hash of the text; turns with
    the same number, repeated rows too, all stay.  Rows without a conversation id belong to
    none and are left out.  A missing role is rendered as ``user``, a missing text as an empty
    one, but for finding snapshots both differ from any other value.  Extra columns are not
    read; an empty table gives an empty result.
    """
    prefixes = prefix_hashes(turns, conv_id, turn, role, text)
    kept = stage(maximal_conversations(prefixes), "conversations")
    line = F.concat(
        F.lit(START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n")
    )
    segment = F.floor((F.col("n") - 1) / segment_turns).cast("int")
    lines = prefixes.join(kept, "conv_id").select("conv_id", "n_turns", segment.alias("segment"), "n", line.alias("line"))
    grouped = lines.groupBy("conv_id", "n_turns", "segment").agg(
        F.count("*").cast("int").alias("segment_turns"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("all")
    )
    return grouped.select(
        "conv_id", "n_turns", "segment", "segment_turns", F.array_join(F.col("all.line"), "").alias("rendered")
    )
