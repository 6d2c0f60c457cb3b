"""Removal of repeated word passages by rolling hashes of every fixed-length window.

Documents are grouped into chunks, ranges of doc_id with about the same amount of text.  A
chunk hashes all windows of its documents (a polynomial rolling hash over 64-bit word
hashes, modulo 2^64) and sends each distinct hash once, sorted and packed, to the range of
hashes it falls in.  There the hashes of all chunks are counted: since chunks are ordered by
doc_id, one bit per hash says all that its chunk has to know, namely whether an earlier chunk
has it too.  The chunk then finds the windows whose sequence starts in a smaller document,
merges them into maximal intervals and removes the words they cover.

Copies within a chunk fold before anything is sent, so a passage repeated a million times
costs one hash per chunk and there are no hot keys.  Hash ranges and chunks are of bounded
size: their numbers grow with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, fresh_names, map_arrow, ship, tasks, text_column, words, worker_copy

WINDOW = 13
CHUNK_BYTES = 8_000_000
LEAST_CHUNK_BYTES = 1_000_000
RANGE_BYTES = 24_000_000  # text per range of hashes: about four million windows
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of each window of ``size`` word hashes, by prefix sums modulo 2^64."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(values), BASE), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(values), INVERSE), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * inverse, dtype=np.uint64)])
    hashes = (sums[size:] - sums[:-size]) * powers[: len(values) - size + 1]
    return hashes ^ (hashes >> np.uint64(29))


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal [start, end) word intervals covered by windows at the sorted ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > size)
    firsts = starts[np.concatenate([[0], breaks + 1])]
    lasts = starts[np.append(breaks, len(starts) - 1)]
    return [(int(a), int(b) + size) for a, b in zip(firsts, lasts, strict=True)]


class ChunkWindows:
    """All windows of a chunk: distinct sorted hashes and where each one occurs."""

    def __init__(self, doc_ids: list[int | None], texts: list[str | None], size: int):
        hashed, parts = WordHashes(seed=1), []
        for doc_id, text in zip(doc_ids, texts, strict=True):
            # A document without an id has no smaller or larger ones.
            found = hashed.of(words(text)) if doc_id is not None else np.zeros(0, np.uint64)
            parts.append(window_hashes(found, size))
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(every)
        ranked = every[order]
        new = np.ones(len(every), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.hashes = ranked[new]
        self.number = np.empty(len(every), np.int64)  # which distinct hash each window has
        self.number[order] = np.cumsum(new) - 1
        owner = np.repeat(np.array([-1 if d is None else d for d in doc_ids], np.int64), self.counts)
        self.owner = owner
        first = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(every) else owner
        self.later_here = owner > first[self.number] if len(every) else np.zeros(0, bool)

    def repeated(self, earlier: np.ndarray) -> list[np.ndarray]:
        """Per document the sorted window starts to remove; ``earlier``: a bit per distinct hash."""
        hit = self.later_here | earlier[self.number] if len(self.number) else self.later_here
        bounds = np.cumsum(self.counts)
        at = np.flatnonzero(hit)
        cuts = np.searchsorted(at, np.concatenate([[0], bounds]))
        return [at[a:b] - (e - n) for a, b, e, n in zip(cuts[:-1], cuts[1:], bounds, self.counts, strict=True)]


def pack_sorted(hashes: np.ndarray, base: int) -> bytes:
    """Sorted hashes as differences of six bytes, or whole where one does not fit."""
    steps = np.diff(hashes, prepend=np.uint64(base))
    if len(steps) and int(steps.max()) >> 48:
        return b"\x08" + hashes.astype("<u8").tobytes()
    return b"\x06" + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_sorted(raw: bytes, base: int) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, "<u8", offset=1)
    steps = np.zeros((len(raw) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, 6)
    return np.uint64(base) + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def chunk_edges(docs: DataFrame, doc_id: str, size: str, chunk_bytes: int) -> list[int]:
    """Last doc_id of each chunk: one number per ``chunk_bytes`` of text comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, edges = 0, None, []
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held >= chunk_bytes and key != last:
                    edges.append(last)
                    held = 0
                held, last = held + n, key
        if last is not None:
            edges.append(last)
        yield pa.RecordBatch.from_arrays([pa.array(edges, pa.int64())], ["edge"])

    # Equal ids are one partition's: a chunk is never cut within an id.
    sums = docs.filter(F.col(f"`{doc_id}`").isNotNull()).groupBy(doc_id).agg(F.sum(size).alias("n"))
    ordered = sums.repartitionByRange(doc_id).sortWithinPartitions(doc_id)
    return sorted(r["edge"] for r in map_arrow(ordered, run, "edge long").collect())


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``docs`` without the words of windows whose sequence also starts in a smaller doc_id.

    Words are runs of characters other than space and U+0009 to U+000D, taken unchanged.
    All windows are judged on the input.  Returns the columns of ``docs`` with the new text,
    where a text that lost words has its other words joined by one space, and the array
    ``removed`` of the removed word intervals (start, end).  With ``digest`` instead:
    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A NULL text has no words and stays NULL; texts shorter than a window lose none.  Rows
    with the same doc_id do not count as smaller than each other; a row without a doc_id
    neither loses words nor takes them from others.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    chunk, key, size, removed = fresh_names(docs, "chunk", "key", "size", "removed")
    rows = docs.withColumns({key: F.col(f"`{doc_id}`").cast("long"), text: text_column(text)})
    rows = rows.select(key, text) if digest else rows
    names = [c for c in rows.columns if c != key]
    light = rows.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(size))
    total = light.agg(F.sum(size)).first()[0] or 0
    chunk_bytes = max(min(chunk_bytes, total // (2 * tasks(spark))), min(LEAST_CHUNK_BYTES, chunk_bytes))
    edges = np.array(chunk_edges(light, key, size, chunk_bytes), np.int64)
    # Ranges of hashes: a power of two, so that the top bits name the range.
    bits = max(int(total // RANGE_BYTES).bit_length(), int(tasks(spark) - 1).bit_length(), 1)
    shift = 64 - bits

    @F.pandas_udf("long")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64)))

    by_chunk = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(text), F.lit(len(edges) + 1)))
    source = rows.withColumn(chunk, by_chunk.otherwise(chunk_of(F.coalesce(key, F.lit(0).cast("long")))))
    grouped = source.groupBy(chunk)  # used twice in one query, so its shuffle is made once

    def send(found: pa.Table) -> pa.Table:
        worker_copy("chunk windows", dict)  # nothing else stays in memory beside a chunk
        number = found.column(chunk)[0].as_py()
        hashes = ChunkWindows(found.column(key).to_pylist(), found.column(text).to_pylist(), window).hashes
        cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(shift))
        names, blobs = [], []
        for name, part in enumerate(np.split(hashes, cuts)):
            if len(part):
                names.append(name)
                blobs.append(pack_sorted(part, name << shift))
        return pa.table({
            "chunk": pa.array([number] * len(names), pa.int64()), "part": pa.array(names, pa.int64()),
            "blob": pa.array(blobs, pa.binary()),
        })

    def count(found: pa.Table) -> pa.Table:
        """For each chunk's hashes of one range: does an earlier chunk have them?"""
        name = found.column("part")[0].as_py()
        chunks = np.array(found.column("chunk").to_pylist())
        order = np.argsort(chunks)
        blobs = found.column("blob").to_pylist()
        each = [unpack_sorted(blobs[i], name << shift) for i in order]
        every = np.concatenate(each)
        rank = np.argsort(every, kind="stable")  # equal hashes stay in the order of chunks
        earlier = np.zeros(len(every), bool)
        ranked = every[rank]
        earlier[rank[1:]] = ranked[1:] == ranked[:-1]
        ends = np.cumsum([len(e) for e in each])
        flags = [np.packbits(f, bitorder="little").tobytes() for f in np.split(earlier, ends[:-1])]
        return pa.table({
            "chunk": pa.array(chunks[order], pa.int64()), "part": pa.array([name] * len(each), pa.int64()),
            "flags": pa.array(flags, pa.binary()), "n": pa.array([len(e) for e in each], pa.int64()),
        })

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column(text).to_pylist()
        windows = ChunkWindows(left.column(key).to_pylist(), texts, window)
        right = right.sort_by("part")
        flags = [
            np.unpackbits(np.frombuffer(f, np.uint8), count=n, bitorder="little")
            for f, n in zip(right.column("flags").to_pylist(), right.column("n").to_pylist(), strict=True)
        ]
        earlier = np.concatenate(flags).view(bool) if flags else np.zeros(len(windows.hashes), bool)
        total_words, lost, digests, new_texts, spans = [], [], [], [], []
        for content, starts in zip(texts, windows.repeated(earlier), strict=True):
            found, cut = words(content), intervals(starts, window)
            kept, at = [], 0
            for a, b in cut:
                kept.extend(found[at:a])
                at = b
            kept.extend(found[at:])
            total_words.append(len(found))
            lost.append(len(found) - len(kept))
            if digest:
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            else:
                new_texts.append(b" ".join(kept).decode() if cut else content)
                spans.append([{"start": a, "end": b} for a, b in cut])
        if digest:
            return pa.table({
                "doc_id": left.column(key), "n_words": pa.array(total_words, pa.int64()),
                "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
            })
        out = left.select(names)
        out = out.set_column(names.index(text), text, pa.array(new_texts, pa.string()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return out.append_column(removed, pa.array(spans, kind))

    sent = grouped.applyInArrow(send, "chunk long, part long, blob binary")
    flagged = sent.groupBy("part").applyInArrow(count, "chunk long, part long, flags binary, n long")
    if digest:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names)
        schema += f", `{removed}` array<struct<start: int, end: int>>"
    return grouped.cogroup(flagged.groupBy("chunk")).applyInArrow(apply, schema)
