"""Ranked lexical search: Block-Max MaxScore over shards of compressed posting lists.

One pass counts documents and terms, a second one writes the index: every task cuts its
documents into shards and writes one row per shard, with a posting list for each term that the
queries use.  A list is cut into blocks of ``BLOCK`` postings, compressed one by one; beside
each block stand its first and last document and its largest contribution.

Queries then run over all shards.  The lists of a query are ordered by the most they can add.
Those whose bounds together stay below the worst of the best scores so far are not essential:
no document that stands only in them can enter.  The essential lists are read whole and give
the candidates; on the others, a candidate whose score cannot reach the worst one even with
the maximum of the block it would stand in is rejected before that block is decompressed.
Every task keeps the best of its shards, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ASCII_LOWER, map_arrow, stage, text_column, worker_copy

BEST = 20
BLOCK = 128
SHARD_BYTES = 4_000_000
SHARD_DOCS = 50_000  # places in a shard are 16-bit numbers
QUERY_TERMS = 500_000  # distinct terms of a block of queries
SLICE = 1 << 22

#: Separators are U+0000-2F, 3A-40, 5B-60 and 7B-7F; only A-Z are lower-cased.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TO_TERMS = bytes(0x20 if b in SEPARATORS else ASCII_LOWER[b] for b in range(256))
INDEX = "docs binary, missing binary, terms array<int>, counts array<int>, blocks binary, data binary"


def term_slices(text: str | None) -> Iterator[list[bytes]]:
    """All terms of a text, in lists of bounded size."""
    data = text.encode().translate(TO_TERMS) if text else b""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for batch in batches:
        for text in batch.column(0):
            size = sum(map(len, term_slices(text.as_py())))
            documents, total = documents + (size > 0), total + size
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], ["documents", "total"])


def contribution(tf: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A posting's score before the weight of its term."""
    length = 100 - 25 + (25 * size * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * length)


def pack_shard(doc_ids: list[int | None], sizes: list[int], ids: list[np.ndarray], documents: int, total: int) -> dict:
    """The row of one shard: ids, terms with their document counts, block heads, block data."""
    n = len(doc_ids)
    place = np.repeat(np.arange(n), list(map(len, ids)))
    pairs, tf = np.unique(np.concatenate(ids).astype(np.int64) * n + place, return_counts=True)
    term, place = pairs // n, pairs % n
    value = contribution(tf.astype(np.int64), np.array(sizes, np.int64)[place], documents, total)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    counts = np.diff(np.append(starts, len(term)))
    blocks = -(-counts // BLOCK)
    inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.repeat(starts, blocks) + BLOCK * inside
    ends = np.minimum(at + BLOCK, np.repeat(starts + counts, blocks))
    pack = zstandard.ZstdCompressor(level=1)
    places, values = place.astype("<u2"), value.astype("<u4")
    data = [
        pack.compress(places[a:b].tobytes() + values[a:b].tobytes()) for a, b in zip(at.tolist(), ends.tolist(), strict=True)
    ]
    most = np.maximum.reduceat(value, at) if len(at) else value
    sized = np.fromiter(map(len, data), np.int64, len(data))
    heads = np.stack([place[at], place[ends - 1], most, ends - at, sized]).astype("<i4")
    return {
        "docs": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "missing": np.array([d is None for d in doc_ids], "u1").tobytes(),
        "terms": term[starts].astype(np.int32), "counts": counts.astype(np.int32),
        "blocks": heads.tobytes(), "data": b"".join(data),
    }


class Shard:
    """One shard; a block is decompressed when it is first needed."""

    def __init__(self, row: dict):
        self.docs, self.missing = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["missing"], "u1").view(bool)
        terms, counts = np.asarray(row["terms"], np.int64), np.asarray(row["counts"], np.int64)
        heads = np.frombuffer(row["blocks"], "<i4").reshape(5, -1).astype(np.int64)
        self.first, self.last, self.most, self.size, sized = heads
        self.at, self.data = np.concatenate([[0], np.cumsum(sized)]), memoryview(row["data"])
        ends = np.cumsum(-(-counts // BLOCK))
        starts = ends - -(-counts // BLOCK)
        self.span = dict(zip(terms.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        tops = np.maximum.reduceat(self.most, starts) if len(starts) else starts
        self.top = dict(zip(terms.tolist(), tops.tolist(), strict=True))
        self._unpack, self._kept = zstandard.ZstdDecompressor(), {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._kept:
            raw, n = self._unpack.decompress(self.data[self.at[k] : self.at[k + 1]]), int(self.size[k])
            self._kept[k] = (
                np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<u4", n, 2 * n).astype(np.int64)
            )
        return self._kept[k]

    def some(self, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The postings of some blocks of one list, in order."""
        found = [self.block(k) for k in blocks]
        return np.concatenate([p for p, _ in found]), np.concatenate([v for _, v in found])

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        name = ("list", term)
        if name not in self._kept:
            self._kept[name] = self.some(range(*self.span[term]))
        return self._kept[name]

    def search(self, weights: dict[int, int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that score at least ``least`` (and above 0)."""
        least = max(least, 1)
        lists = sorted((w * self.top[t], t, w) for t, w in weights.items() if w > 0 and t in self.top)
        bounds = np.cumsum([b for b, _, _ in lists])
        essential = int(np.searchsorted(bounds, least))
        scores = np.zeros(len(self.docs), np.int64)
        for _, term, weight in lists[essential:]:
            places, values = self.whole(term)
            scores[places] += weight * values
        scores[self.missing] = 0
        places = np.flatnonzero(scores)
        scores = scores[places]
        for k in range(essential - 1, -1, -1):
            _, term, weight = lists[k]
            near = scores + bounds[k] >= least
            places, scores = places[near], scores[near]
            if not len(places):
                break
            start, end = self.span[term]
            block = start + np.searchsorted(self.last[start:end], places)
            inside = np.minimum(block, end - 1)
            stands = (block < end) & (self.first[inside] <= places)
            below = bounds[k - 1] if k else 0
            near = scores + np.where(stands, weight * self.most[inside], 0) + below >= least
            places, scores, block, stands = places[near], scores[near], block[near], stands[near]
            if stands.any():
                there, values = self.some(np.unique(block[stands]).tolist())
                spot = np.minimum(np.searchsorted(there, places), len(there) - 1)
                scores = scores + np.where(there[spot] == places, weight * values[spot], 0)
        good = scores >= least
        return places[good], scores[good]


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], documents: int, total: int) -> DataFrame:
    """Shards of (doc_id long, text) rows for the terms of ``vocabulary``; one row per shard."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_copy("lexical index", dict)  # nothing else stays in memory beside it
        number = shared.value.get
        doc_ids, sizes, ids, held = [], [], [], 0
        schema = pa.schema([
            ("docs", pa.binary()), ("missing", pa.binary()), ("terms", pa.list_(pa.int32())),
            ("counts", pa.list_(pa.int32())), ("blocks", pa.binary()), ("data", pa.binary()),
        ])

        def flush():
            row = pack_shard(doc_ids, sizes, ids, documents, total)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                size, found = 0, []
                for terms in term_slices(text.as_py()):
                    part = np.fromiter(map(number, terms, repeat(-1)), np.int32, len(terms))
                    found.append(part[part >= 0])
                    size += len(terms)
                if not size:
                    continue
                doc_ids.append(doc_id)
                sizes.append(size)
                ids.append(np.concatenate(found))
                held += 8 * size
                if held >= SHARD_BYTES or len(doc_ids) >= SHARD_DOCS:
                    yield flush()
                    doc_ids, sizes, ids, held = [], [], [], 0
        if doc_ids:
            yield flush()

    return map_arrow(docs, run, INDEX)


def best_documents(index: DataFrame, queries: list[tuple], weights: list[dict[int, int]], kind: pa.DataType,
                   id_type: str, best: int) -> DataFrame:
    """The best documents of each query in every task's shards."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                for q, weight in enumerate(wanted):
                    scores, ids = held[q]
                    places, more = shard.search(weight, int(scores[-1]) if len(scores) == best else 0)
                    if len(places):
                        scores, ids = np.concatenate([scores, more]), np.concatenate([ids, shard.docs[places]])
                        order = np.lexsort((ids, -scores))[:best]
                        held[q] = (scores[order], ids[order])
        sizes = [len(s) for s, _ in held]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(names)), sizes), pa.int32()),
            pa.array([name for name, size in zip(names, sizes, strict=True) for _ in range(size)], kind),
            pa.array(np.concatenate([i for _, i in held] or [[]]), pa.int64()),
            pa.array(np.concatenate([s for s, _ in held] or [[]]), pa.int64()),
        ], ["query", "item_id", "doc_id", "score"])

    return map_arrow(index, run, f"query int, item_id {id_type}, doc_id long, score long")


def query_blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[list[bytes]], dict[bytes, int]]]:
    """Queries with their terms and a numbering of these, in blocks of bounded vocabulary."""
    names, terms, vocabulary = [], [], {}
    for row in queries.select(F.col(f"`{item_id}`"), text_column(text)).toLocalIterator():
        found = [t for part in term_slices(row[1]) for t in part]
        for term in found:
            vocabulary.setdefault(term, len(vocabulary))
        names.append(row[0])
        terms.append(found)
        if len(vocabulary) >= QUERY_TERMS:
            yield names, terms, vocabulary
            names, terms, vocabulary = [], [], {}
    if vocabulary:
        yield names, terms, vocabulary


def lexical_search(
    docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    query: str = "text", best: int = BEST,
) -> DataFrame:
    """The ``best`` highest-scoring documents of each query: item_id, rank, doc_id, score.

    A term counts w * ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))),
    m = 75 + (25 n N) div L, as often as it stands in the query; equal scores go by doc_id.
    Queries come in blocks of about ``QUERY_TERMS`` distinct terms, each one pass over the
    documents; their terms are broadcast, at most that many and those of one more query.

    A NULL or empty text has no terms: as a document it does not count, as a query it finds
    nothing.  Every row is a document and every row is a query, also with a repeated id;
    ``doc_id`` is cast to long, and a row without one counts in N, L and df but is never found.
    A query without an id keeps its NULL.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").try_cast("long").alias("doc_id"), text_column(text).alias("text"))
    sums = map_arrow(rows.select("text"), _count, "documents long, total long")
    documents, total = sums.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    id_type = queries.schema[item_id].dataType.simpleString()
    kind = spark.createDataFrame([], f"id {id_type}").toArrow().schema[0].type
    found = []
    for names, terms, vocabulary in query_blocks(queries, item_id, query) if total else ():
        index = stage(build_index(rows, vocabulary, documents, total), "lexical-index")
        counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts"))
        weight = {t: floor(1000 * log((2 * documents + 2) / (2 * df + 1))) for t, df in counted.collect()}
        weights = []
        for own in terms:
            sums = {}
            for term in map(vocabulary.__getitem__, own):
                sums[term] = sums.get(term, 0) + weight.get(term, 0)
            weights.append(sums)
        heaps = best_documents(index, names, weights, kind, id_type, best)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        found.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
