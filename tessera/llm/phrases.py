"""Phrase collocations from a weighted de Bruijn graph of word triples.

Nodes are pairs of neighbouring words, edges are triples: an edge leads from its first two
words to its last two.  Every word of a piece starts one edge; at a piece's end the missing
words are a mark, so the ends correct the counts of shorter phrases: a pair's count is what
flows out of its node, the mark included, and a word's count is the flow of the nodes it starts.

Only phrases that occur ``least`` times matter, and most edges do not.  A first pass therefore
counts edges by a 64-bit hash (the upper part names the node, so hashes also give node flows)
and leaves two bitmaps of bounded size, of edges and nodes that may be frequent.  A second
pass counts words, and those nodes and edges, by their text.  A full bitmap or two texts
with one hash only let more rows through; counts are always of texts.

Frequent edges are then compacted: where a node has one edge in and one out, both belong to one
path, found by pointer doubling.  Inside a path the longer phrases around a pair are its two
neighbours; only at path ends do edges of several paths have to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ASCII_LOWER, map_arrow, stage, tasks, text_column, worker_copy

LEAST, TOP, COVERED_PCT = 10, 2000, 50
CHUNK_WORDS = 1 << 20
SLICE = 1 << 22
NODE_SHIFT = 24  # an edge's hash: 40 bits of its node, 24 of its third word
MIN_BITS, MAX_BITS = 16, 29
ANCHORS = 16  # one node in so many ends a path, so that paths stay short
ROUNDS = 10
MERGED = 8  # parts of a language before the last

END = b"\xff"  # in no UTF-8 text
MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", END * 10 + b" ")
TO_WORDS = bytes(MARKS[b] for b in ASCII_LOWER)
ODD = [np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text with ``END`` between pieces and twice at the end, in bounded lists."""
    data = text.encode().translate(TO_WORDS).replace(END, b" \xff ") if text else b""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found = data[at:end].split()
        at = end
        yield found + [END, END] if at == len(data) else found


class Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, thing) -> int:
        self[thing] = len(self)
        return self[thing]


class Chunk:
    """The edges that start in a stretch of text: numbers of language and of three words."""

    def __init__(self, langs: Numbers, words: Numbers, ids: np.ndarray, owner: np.ndarray):
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        keep = first != 0
        self.langs, self.words, self.owner = list(langs), list(words), owner[:-2][keep]
        self.first, self.second = first[keep], second[keep]
        self.third = np.where(second == 0, 0, third)[keep]

    def hashes(self) -> np.ndarray:
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        tongue = np.array([xxhash.xxh64_intdigest(t.encode(), 1) for t in self.langs], np.uint64)
        node = ((tongue[self.owner] * ODD[0] ^ own[self.first]) * ODD[1] ^ own[self.second]) * ODD[2]
        node = (node ^ node >> np.uint64(29)) * ODD[0]
        third = own[self.third] * ODD[1]
        return node >> np.uint64(NODE_SHIFT) << np.uint64(NODE_SHIFT) | third >> np.uint64(64 - NODE_SHIFT)

    def counted(self, size: int, keep: np.ndarray) -> pa.RecordBatch:
        """Texts and counts of the first ``size`` words of the kept edges."""
        n, key = len(self.words), self.owner[keep]
        for column in (self.first, self.second, self.third)[:size]:
            if int(key.max(initial=0)) >= (1 << 62) // n:
                key = np.unique(key, return_inverse=True)[1]
            key = key * n + column[keep]
        key, at, counts = np.unique(key, return_index=True, return_counts=True)
        text = pa.array(self.words, pa.binary())
        parts = [text.take(pa.array(c[keep][at])) for c in (self.first, self.second, self.third)[:size]]
        joined = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.owner[keep][at]))
        return pa.RecordBatch.from_arrays(
            [lang, pa.array(np.full(len(at), size), pa.int32()), joined.cast(pa.string()), pa.array(counts, pa.int64())],
            ["lang", "size", "phrase", "f"],
        )


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of about ``CHUNK_WORDS`` words; a text that is cut goes on with its last two words."""
    worker_copy("phrase chunks", dict)  # nothing else stays in memory beside a chunk
    langs, words, ids, owner, held = Numbers(), Numbers({END: 0}), [], [], 0

    def close():
        return Chunk(langs, words, np.concatenate(ids), np.concatenate(owner))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for found in word_slices(text.as_py()):
                ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                owner.append(np.full(len(found), langs[lang]))
                held += len(found)
                if held >= CHUNK_WORDS:
                    yield close()
                    names, tail = list(words), np.concatenate(ids)[-2:].tolist()
                    langs, words = Numbers(), Numbers({END: 0})
                    ids = [np.array([words[names[k]] for k in tail])]
                    owner, held = [np.full(len(tail), langs[lang])], 0
    if held:
        yield close()


def spread(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ hashes >> np.uint64(33)) * ODD[1]
    return (hashes ^ hashes >> np.uint64(29)) * ODD[2]


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (8 * len(bitmap)).bit_length() - 1
    place = spread(hashes) >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def likely_bitmaps(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the edges and of the nodes whose hash occurs at least ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found, counts = np.unique(chunk.hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["h", "n"])

    edges = map_arrow(rows, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    nodes = edges.groupBy(F.shiftrightunsigned("h", NODE_SHIFT).alias("h")).agg(F.sum("n").alias("n"))
    often = F.col("n") >= least
    likely = stage(
        edges.filter(often).select(F.lit(0).alias("kind"), "h")
        .unionByName(nodes.filter(often).select(F.lit(1).alias("kind"), "h")), "likely-phrases",
    )
    sizes = {r["kind"]: r["count"] for r in likely.groupBy("kind").count().collect()}
    bits = [min(max((32 * sizes.get(kind, 0)).bit_length(), MIN_BITS), MAX_BITS) for kind in (0, 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            shift = np.where(kind == 0, 64 - bits[0], 64 - bits[1]).astype(np.uint64)
            at = (spread(h) >> shift).view(np.int64) + 1  # buckets of positive numbers start at 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["kind", "place"])

    slices = (
        map_arrow(likely, place, "kind int, place long")
        .groupBy("kind", F.bitmap_bucket_number("place").alias("slice"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    maps = tuple(np.zeros(max(1 << b - 3, 4096), np.uint8) for b in bits)
    for row in slices.toLocalIterator():
        at = 4096 * (row["slice"] - 1)
        maps[row["kind"]][at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return maps[0][: 1 << bits[0] - 3], maps[1][: 1 << bits[1] - 3]


def count_phrases(docs: DataFrame, lang: str, text: str, least: int) -> DataFrame:
    """lang, size, phrase, f: every word, and every pair and triple that occurs ``least`` times."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), text_column(text))
    shared = docs.sparkSession.sparkContext.broadcast(likely_bitmaps(rows, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, nodes = shared.value
        for chunk in chunks(batches):
            hashes = chunk.hashes()
            yield chunk.counted(1, np.ones(len(hashes), bool))
            # All that flows out of a node, the mark of a piece's end included.
            yield chunk.counted(2, has(nodes, hashes >> np.uint64(NODE_SHIFT)) & (chunk.second != 0))
            yield chunk.counted(3, has(edges, hashes) & (chunk.third != 0))

    counts = map_arrow(rows, count, "lang string, size int, phrase string, f long")
    summed = counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return stage(summed.filter((F.col("size") == 1) | (F.col("f") >= least)), "phrases")


def first_words(phrase, n: int):
    return F.substring_index(phrase, " ", n)


def compact_paths(edges: DataFrame, anchors: int = ANCHORS, rounds: int = ROUNDS) -> DataFrame:
    """Maximal unary paths of edges (lang, phrase of three words, f): lang, edges (array of phrase, f).

    A node with one edge in and one out is inside a path, unless it is one of the hashed
    anchors that keep paths short.  Circles, and what is not joined after ``rounds`` doublings,
    stay paths of one edge.
    """
    edges = edges.select("lang", "phrase", "f", first_words(F.col("phrase"), 2).alias("tail"),
                         first_words(F.col("phrase"), -2).alias("head"))
    out = edges.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("n_in"), F.max("phrase").alias("up"))
    anchor = F.pmod(F.xxhash64("lang", "node"), F.lit(anchors)) == 0
    inside = out.join(into, ["lang", "node"]).filter((F.col("n_out") == 1) & (F.col("n_in") == 1) & ~anchor)
    state = stage(
        edges.join(inside.select("lang", F.col("node").alias("tail"), "up"), ["lang", "tail"], "left").select(
            "lang", "phrase", "f", F.coalesce("up", "phrase").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps"),
            F.col("up").isNull().alias("done"),
        ),
        "paths",
    )
    left = state.filter("NOT done").count()
    for _ in range(rounds):
        if not left:
            break
        above = state.selectExpr("lang", "phrase AS up", "up AS further", "steps AS more", "done AS arrived")
        moved = state.filter("NOT done").join(above, ["lang", "up"]).selectExpr(
            "lang", "phrase", "f", "further AS up", "steps + more AS steps", "arrived AS done"
        )
        state = stage(state.filter("done").unionByName(moved), "paths")
        before, left = left, state.filter("NOT done").count()
        if left == before:
            break  # every path has an edge that arrives in this round: only circles are left
    root = F.when(F.col("done"), F.col("up")).otherwise(F.col("phrase"))
    step = F.when(F.col("done"), F.col("steps")).otherwise(0)
    found = F.sort_array(F.collect_list(F.struct(step.alias("step"), "phrase", "f")))
    return state.groupBy("lang", root.alias("root")).agg(found.alias("edges")).select("lang", "edges")


def most_above(paths: DataFrame) -> DataFrame:
    """lang, phrase of two words, above: the largest count of an edge that holds the pair."""
    edge = paths.select("lang", F.size("edges").alias("n"), F.posexplode("edges").alias("i", "e"), "edges")
    before = F.when(F.col("i") > 0, F.get("edges", F.col("i") - 1)["f"])
    tails = edge.select("lang", first_words(F.col("e.phrase"), 2).alias("phrase"),
                        F.greatest(F.col("e.f"), before).alias("above"), (F.col("i") > 0).alias("inside"))
    heads = edge.filter("i = n - 1").select("lang", first_words(F.col("e.phrase"), -2).alias("phrase"),
                                            F.col("e.f").alias("above"), F.lit(False).alias("inside"))
    inner = tails.filter("inside").select("lang", "phrase", "above")
    ends = tails.filter("NOT inside").unionByName(heads).groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    return inner.unionByName(ends)


def score_cuts(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """Each candidate's lowest-scoring cut (the first of equal ones): l, r and score are added."""
    halves = [
        F.struct(F.lit(k).alias("k"), first_words(F.col("phrase"), k).alias("left"),
                 F.substring_index("phrase", " ", k - size).alias("right"), F.lit(size).alias("of"))
        for size in (2, 3) for k in range(1, size)
    ]
    cuts = candidates.select("lang", "phrase", "size", "a", F.inline(F.array(*halves))).filter("size = of")
    left = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    exact = "CAST((CAST(1000000 AS DECIMAL(38, 0)) * a * a) DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT) AS score"
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).selectExpr("lang", "phrase", "a", "k", "l", "r", exact)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_rows(df: DataFrame, spark: SparkSession, top: int) -> DataFrame:
    """The first ``top`` rows of each language: of many parts, then of few, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = df
    for parts in (tasks(spark), MERGED):
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        few = few.withColumn("part", part).withColumn(
            "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        ).filter(F.col("place") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, covered_pct: int = COVERED_PCT
) -> DataFrame:
    """The first ``top`` phrases of two or three words per language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces at ``.,;:!?`` and line ends, A-Z are lower-cased, words stand
    between spaces and tabs.  a counts a phrase inside pieces; a phrase with a >= ``least`` is a
    candidate, its score the lowest floor(10^6 a a / (l r)) over its cuts.  A pair inside a
    candidate that occurs in ``covered_pct`` % of its places or more is dropped.

    A NULL language is ``und``, as is that name; a NULL or empty text has no words, and neither
    have pieces of marks alone.  Repeated rows count each time; equal scores go by a, then by
    the phrase's bytes.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = count_phrases(docs, lang, text, least)
    words = counts.filter("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.filter(F.col("f") >= least)
    paths = stage(compact_paths(often.filter("size = 3").select("lang", "phrase", "f")), "phrase-paths")
    candidates = often.filter("size > 1").withColumnRenamed("f", "a").join(most_above(paths), ["lang", "phrase"], "left")
    kept = candidates.filter((F.col("size") == 3) | F.col("above").isNull() | (100 * F.col("above") < covered_pct * F.col("a")))
    scored = score_cuts(kept, often.filter("size < 3"))
    return first_rows(scored, spark, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
