"""SimHash near-duplicates, found without misses by covering masks.

For radius r every bit gets a nonzero vector of r + 1 bits, and every nonzero vector v of that
size a mask with the bits whose vector has odd product with v.  The vectors of at most r
differing bits span less than the whole space, so some v is orthogonal to all of them: in its
table the pair agrees on every masked bit.  All pairs within the radius therefore meet in one
of 2^(r+1) - 1 tables (15 at radius 3).

Only distinct fingerprints are compared, so exact copies cost one row.  Rows are dealt and
sorted by table and masked bits; a streaming pass joins what is linked in a bucket to one
root and emits no pairs.  A bucket above ``BUCKET`` fingerprints goes on to tables of the bits
its mask left open, under the same guarantee: these halve each time, so that after a few
levels a bucket cannot hold more than 2^(open bits) fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, batched, fresh_names, map_arrow, stage, text_column, worker_copy
from tessera.llm.components import connected_components

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
BUCKET = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without a word."""
    found = text.encode().translate(ASCII_LOWER).split() if text else []
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)  # one shingle: its bits are the majority
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)],
        np.uint64, len(starts),
    )
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(open_bits: list[int], radius: int) -> list[int]:
    """One mask over ``open_bits`` for each nonzero vector of radius + 1 bits."""
    vectors = (1 << (radius + 1)) - 1
    given = {bit: i % vectors + 1 for i, bit in enumerate(open_bits)}
    return [sum(1 << b for b, m in given.items() if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]


def mask_levels(radius: int, levels: int) -> list[np.ndarray]:
    """Masks of each level; table t of a level has its children at t * tables + i of the next."""
    out = [np.array(covering_masks(list(range(BITS)), radius), np.uint64)]
    for _ in range(levels - 1):
        below = []
        for mask in out[-1].tolist():
            left = [b for b in range(BITS) if not mask >> b & 1]
            below.extend(mask | m for m in covering_masks(left, radius))
        out.append(np.array(below, np.uint64))
    return out


def link_bucket(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of the groups that links within the radius form in one bucket."""
    left, roots, members = prints, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        waiting = [root]
        while waiting and len(left):
            near = np.bitwise_count(left ^ waiting.pop()) <= radius
            if near.any():
                hit, left = left[near], left[~near]
                waiting.extend(hit)
                members.extend(hit.tolist())
                roots.extend([int(root)] * len(hit))
    return np.array(roots, np.uint64), np.array(members, np.uint64)


def _bucket_pass(radius: int, limit: int | None):
    """Over rows sorted by (table, key): edges of small buckets, rows of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept, hot = None, [], False  # the bucket that the next batch may go on with

        def result(tables, a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(tables, np.int32)), pa.array(np.asarray(a, np.uint64).view(np.int64)),
                 pa.array(np.asarray(b, np.uint64).view(np.int64))],
                ["table", "a", "b"],
            )

        def close():
            prints = np.concatenate(kept)
            if len(prints) < 2:
                return None
            roots, members = link_bucket(np.unique(prints), radius)
            return result(np.full(len(roots), -1), roots, members) if len(roots) else None

        for batch in batches:
            table, key, prints = (batch.column(c).to_numpy() for c in ("table", "key", "print"))
            prints = prints.view(np.uint64)
            change = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
            starts = np.concatenate([[0], change])
            ends = np.append(change, len(table))
            # Buckets of one row inside the batch link nothing.
            for at in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(table))):
                start, end = int(starts[at]), int(ends[at])
                if (int(table[start]), int(key[start])) != name:
                    if kept and not hot and (edges := close()) is not None:
                        yield edges
                    name, kept, hot = (int(table[start]), int(key[start])), [], False
                kept.append(prints[start:end])
                if limit and sum(map(len, kept)) > limit:
                    hot = True
                if hot:
                    rows = np.concatenate(kept)
                    kept = []
                    yield result(np.full(len(rows), name[0]), rows, rows)
        if kept and not hot and (edges := close()) is not None:
            yield edges

    return run


def link_fingerprints(prints: DataFrame, radius: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints linked within the radius.

    ``prints`` has a column ``print`` (long, distinct).  Linked fingerprints are in one
    component of the edges; the edges are not all links.
    """
    tables = (1 << (radius + 1)) - 1
    masks = mask_levels(radius, 3)  # the third level leaves about 8 bits open
    rows = prints.select(F.lit(0).alias("parent"), "print")
    edges = None
    for level, level_masks in enumerate(masks):

        def keys(batches: Iterator[pa.RecordBatch], level_masks=level_masks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parent = np.repeat(batch.column(0).to_numpy(), tables)
                value = np.repeat(batch.column(1).to_numpy().view(np.uint64), tables)
                table = parent * tables + np.tile(np.arange(tables), batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table.astype(np.int32)), pa.array((value & level_masks[table]).view(np.int64)),
                     pa.array(value.view(np.int64))],
                    ["table", "key", "print"],
                )

        dealt = map_arrow(rows, keys, "table int, key long, print long").repartition("table", "key")
        last = level == len(masks) - 1
        found = stage(
            map_arrow(dealt.sortWithinPartitions("table", "key"), _bucket_pass(radius, None if last else bucket),
                      "table int, a long, b long"), "links",
        )
        these = found.filter("table < 0").select("a", "b")
        edges = these if edges is None else edges.union(these)
        rows = found.filter("table >= 0").select(F.col("table").alias("parent"), F.col("a").alias("print"))
        if last or rows.isEmpty():
            break
    return edges


def sign(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of ``text`` (long, the same bits) as column ``name``."""
    source = docs.withColumn(name, text_column(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_copy("fingerprints", dict)  # frees what another operator left
        for batch in batched(batches):
            at = batch.schema.get_field_index(name)
            prints = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64)
            columns = list(batch.columns)
            columns[at] = pa.array(prints.view(np.int64))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(source, run, docs.withColumn(name, F.lit(0).cast("long")).schema)


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = MAX_DISTANCE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    doc_id in the component.  A NULL text, or one without words, has fingerprint zero and is
    linked like any other.  Repeated rows stay; a row without a doc_id takes part but never
    names a component (a component of such rows only has a NULL id).  Other columns are not
    read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_column(text).alias("text"))
    signed = stage(sign(rows, "text", "print", shingle).select("doc_id", "print"), "prints")
    return signed.join(_roots(signed, radius), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _roots(signed: DataFrame, radius: int) -> DataFrame:
    """print, root and component_id of every distinct fingerprint."""
    distinct = stage(signed.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    members = connected_components(link_fingerprints(distinct.select("print"), radius))
    rooted = distinct.join(members, F.col("print") == F.col("node"), "left")
    rooted = rooted.select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stage(rooted.join(least, "root").select("print", "root", "component_id"), "components")


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = MAX_DISTANCE
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Among rows with that same id one stays; a component without any id keeps one row.  All
    columns stay as they are; NULL and empty texts are copies of each other.
    """
    (mark,) = fresh_names(docs, "key")
    # Rows with the same id and text are the same document.
    key = F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.xxhash64(text_column(text)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_column(text).alias("text"), key.alias("key"))
    signed = stage(sign(rows, "text", "print", shingle).select("doc_id", "print", "key"), "prints")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = signed.join(_roots(signed, radius), "print").filter(first).groupBy("root").agg(F.min("key").alias(mark))
    # Repeated rows fold on the map side; the semi join uses the same partitioning.
    out = docs.withColumn(mark, key).dropDuplicates([mark]).join(kept.select(mark), mark, "left_semi")
    return out.select(*[f"`{c}`" for c in docs.columns])
