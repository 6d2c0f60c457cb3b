"""Token ids in wavelet-matrix files: access, counting and lookup in compressed shards.

Documents are range-partitioned by id and encoded; every task writes shards of about
``SHARD_TOKENS`` tokens.  A shard maps its ids to ranks in its own sorted alphabet and keeps
one bit-plane per rank bit, most significant first; after each plane the ranks are dealt
stably, zeros before ones.  Planes are cut into blocks of ``BLOCK`` bits, each compressed
alone, with the number of ones before each block, so a read touches one block per plane.

Layout (little-endian): ``TWM1``, int64 tokens, documents, alphabet size, planes, blocks per
plane; document ids (int64), a byte per document (1: no id), lengths (int64); alphabet
(uint32); zeros per plane (int64); ones before each block (planes x blocks, int64); block
offsets (planes x blocks + 1, int64); block data.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import batched, map_arrow, shared_folder, stage, tasks, text_column
from tessera.llm.tokens import END_ID, encoder, ids_crc32, tokenizer_path

MAGIC = b"TWM1"
BLOCK = 1 << 16
SHARD_TOKENS = 1 << 21


def build(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The file of one shard."""
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    n = len(ids)
    # Ranks without a sort of all tokens: ids are small numbers.
    seen = np.zeros(int(ids.max()) + 1 if n else 0, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    planes = max(int(len(alphabet) - 1).bit_length(), 1) if n else 0
    kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
    ranks = (np.cumsum(seen) - 1).astype(kind)[ids] if n else np.zeros(0, kind)
    blocks = -(-n // BLOCK)
    zeros, ones, offsets, data, size = [], [], [0], [], 0
    pack = zstandard.ZstdCompressor(level=1)
    for plane in range(planes - 1, -1, -1):
        bits = ((ranks >> plane) & 1).astype(bool)
        seen_ones = 0
        packed = np.packbits(bits, bitorder="little")
        for k in range(0, len(packed), BLOCK // 8):
            block = packed[k : k + BLOCK // 8]
            data.append(pack.compress(block.data))
            size += len(data[-1])
            offsets.append(size)
            ones.append(seen_ones)
            seen_ones += int(np.bitwise_count(block).sum())
        # Taking by index is several times faster than by mask.
        low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
        zeros.append(len(low))
        ranks = np.concatenate([ranks.take(low), ranks.take(high)])
    head = np.array([n, len(documents), len(alphabet), planes, blocks], "<i8")
    missing = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [head, keys, missing, lengths.astype("<i8"), alphabet, np.array(zeros, "<i8"),
             np.array(ones, "<i8"), np.array(offsets, "<i8")]
    return MAGIC + b"".join(p.tobytes() for p in parts) + b"".join(data)


class Shard:
    """Reads one shard file; blocks are unpacked when they are needed."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.raw, self.at = memoryview(raw), 4
        self.n, docs, sigma, self.planes, self.blocks = (int(x) for x in self._take("<i8", 5))
        keys, missing = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if m else int(k) for k, m in zip(keys, missing, strict=True)]
        self.lengths = self._take("<i8", docs)
        self.alphabet = self._take("<u4", sigma)
        self.zeros = self._take("<i8", self.planes)
        self.ones = self._take("<i8", self.planes * self.blocks).reshape(self.planes, self.blocks)
        self.offsets = self._take("<i8", self.planes * self.blocks + 1)
        self._unpack = zstandard.ZstdDecompressor()

    def _take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, count, self.at)
        self.at += out.nbytes
        return out

    def _block(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.blocks + block
        data = self._unpack.decompress(self.raw[self.at + self.offsets[k] : self.at + self.offsets[k + 1]])
        left = min(BLOCK, self.n - block * BLOCK)
        return np.unpackbits(np.frombuffer(data, np.uint8), count=left, bitorder="little")

    def _ones_before(self, plane: int, i: int) -> int:
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        block = i // BLOCK
        return int(self.ones[plane, block]) + int(self._block(plane, block)[: i % BLOCK].sum())

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank = 0
        for plane in range(self.planes):
            bit = int(self._block(plane, i // BLOCK)[i % BLOCK])
            before = self._ones_before(plane, i)
            rank, i = rank * 2 + bit, int(self.zeros[plane]) + before if bit else i - before
        return int(self.alphabet[rank])

    def _rank_of(self, token: int) -> int | None:
        rank = int(np.searchsorted(self.alphabet, token))
        return rank if rank < len(self.alphabet) and self.alphabet[rank] == token else None

    def rank(self, token: int, end: int) -> int:
        """How often the token occurs before place ``end``."""
        rank, low, high = self._rank_of(token), 0, max(0, min(end, self.n))
        if rank is None:
            return 0
        for plane in range(self.planes):
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            if rank >> (self.planes - 1 - plane) & 1:
                low, high = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int, start: int, end: int) -> int:
        return max(0, self.rank(token, end) - self.rank(token, start))

    def select(self, token: int, k: int) -> int:
        """Place of the occurrence number ``k`` (from 0)."""
        if not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        rank, low = self._rank_of(token), 0
        for plane in range(self.planes):
            a = self._ones_before(plane, low)
            low = int(self.zeros[plane]) + a if rank >> (self.planes - 1 - plane) & 1 else low - a
        place = low + k
        for plane in range(self.planes - 1, -1, -1):
            bit = rank >> (self.planes - 1 - plane) & 1
            place = self._place(plane, bit, place - int(self.zeros[plane]) if bit else place)
        return place

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this kind in a plane."""
        before = self.ones[plane] if bit else np.arange(self.blocks) * BLOCK - self.ones[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        within = np.flatnonzero(self._block(plane, block) == bit)
        return block * BLOCK + int(within[k - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All tokens: the planes undone from the last to the first."""
        ranks = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._block(plane, b) for b in range(self.blocks)]).view(bool)
            zeros, out = int(self.zeros[plane]), np.empty_like(ranks)
            out[np.flatnonzero(~bits)] = ranks[:zeros]
            out[np.flatnonzero(bits)] = ranks[zeros:] | ranks.dtype.type(1 << (self.planes - 1 - plane))
            ranks = out
        return self.alphabet[ranks] if self.n else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        tokens, at = self.tokens(), 0
        for doc_id, size in zip(self.doc_ids, self.lengths, strict=True):
            yield doc_id, tokens[at : at + int(size)]
            at += int(size)


def file_system(folder: str):
    """The Arrow file system and path of a folder named as Spark names it."""
    if folder.startswith("/"):
        return arrow_fs.LocalFileSystem(), folder
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def write_shards(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    folder: str | None = None,
) -> DataFrame:
    """Encode ``docs`` in ascending order of their id and write the shards.

    Returns the manifest, one row per file: path, n_docs, n_tokens, start (tokens in all
    files before).  A document is never divided between files.  A NULL text is empty (it
    still gets its end id), rows without an id come first, rows with the same id stay side
    by side in no fixed order, other columns are not read, and an empty table gives no file.
    A task that runs again writes files of other names; only those of the run that counted
    are in the manifest.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        held_ids, held, size, number = [], [], 0, 0
        system, root = file_system(folder)

        def flush():
            nonlocal held_ids, held, size, number
            system.create_dir(root, recursive=True)
            name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.twm"
            with system.open_output_stream(f"{root}/{name}.tmp") as out:
                out.write(build(held_ids, held))
            system.move(f"{root}/{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                "path": [f"{folder}/{name}"], "n_docs": pa.array([len(held)], pa.int64()),
                "n_tokens": pa.array([size], pa.int64()),
            })
            held_ids, held, size, number = [], [], 0, number + 1
            return row

        for batch in batched(batches):
            found = encode.closed(batch.column(1).to_pylist(), end_id)
            for key, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                held_ids.append(key)
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"))
    # The second key only divides the rows of an id that very many rows share.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = stage(map_arrow(ordered, write, "part int, number int, path string, n_docs long, n_tokens long"), "shards")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    within = files.withColumn("n", F.col("n_tokens"))
    within = within.withColumn("start", before(Window.partitionBy("part").orderBy("number"))).drop("n")
    out = within.join(parts, "part").withColumn("start", F.col("start") + F.col("base"))
    return out.select("path", "n_docs", "n_tokens", "start")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: doc_id, start, n_tokens, ids_crc32 of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, place = file_system(path)
                with system.open_input_stream(place) as file:
                    shard = Shard(file.read())
                keys, crcs = [], []
                for key, ids in shard.documents():
                    keys.append(key)
                    crcs.append(ids_crc32(ids))
                ends = np.cumsum(shard.lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + ends - shard.lengths, pa.int64()),
                     pa.array(shard.lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A number of parts of its own: a row is small, but the file it names is not.
    spread = manifest.select("path", "start").repartition(tasks(manifest.sparkSession), "path")
    return map_arrow(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
