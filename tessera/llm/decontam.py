"""Benchmark passages in documents, found by an edit-distance embedding.

Symbols are words (lower case, without signs at their ends), hashed to 64 bits.  A CGK walk
reads a window from its start: at step j it writes the symbol under the pointer and moves on
only if a random bit of (j, symbol) says so.  Two windows within a small edit distance stay or
fall back in step, so their walks differ in few places.  Each of several tables hashes a few
sampled steps of a walk; windows that agree in a table are candidates.

A walk of ``STEPS`` steps looks about half as many words ahead.  It is taken from every word
of every document, and from every place in an item from which it can run, so that an item is
found from whichever of its parts has few edits.  Items of fewer than ``PIECED`` words have too
few such places.  With k allowed edits they are cut into k + 1 pieces, one of which is in the
document unchanged, so any piece found makes a candidate and none is missed.

A candidate window as long as the item (with room for the allowed edits) is then compared
exactly (Myers' bit-parallel algorithm); only that decides.  Items of one block are an index of
fixed size that goes to all tasks; more items are more blocks, each a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, batched, fresh_names, map_arrow, text_column, words, worker_copy

MAX_EDITS = 0.2  # of the item's words: similarity 0.8 or more
STEPS = 24
WALKS = 2
TABLES = 8
SAMPLES = 6
BLOCK_ITEMS = 20_000
PIECED = 2 * STEPS  # items of fewer words are found by pieces, longer ones by walks
MOST_PIECE = 5  # words of a piece that are compared before the exact check
FILTER_BITS = 20
EDGE_SIGNS = b"".join(bytes([c]) for c in range(0x21, 0x7F) if not chr(c).isalnum())
HALO = STEPS  # a walk moves at most one word a step


def normal_word(word: bytes) -> bytes:
    """Lower case, without signs at the ends (a word of signs only stays as it is)."""
    return (word.strip(EDGE_SIGNS) or word).decode().lower().encode()


def sampled_steps(seed: int = 20) -> list[tuple[int, list[int]]]:
    """(walk, steps) of each table; the steps are spread over the whole walk."""
    rng, out = np.random.default_rng(seed), []
    for t in range(TABLES):
        cells = np.linspace(0, STEPS, SAMPLES + 1).astype(int)
        out.append((t % WALKS, [int(rng.integers(a, b)) for a, b in zip(cells[:-1], cells[1:], strict=True)]))
    return out


PLAN = sampled_steps()
MIX = np.random.default_rng(21).integers(1, 1 << 63, (TABLES, SAMPLES), dtype=np.int64).astype(np.uint64) | np.uint64(1)
PIECE_MIX = np.random.default_rng(22).integers(1, 1 << 63, MOST_PIECE, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def walk_keys(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys (tables x starts) of the walks from ``starts``; ``symbols`` ends with ``HALO`` fillers."""
    keys = np.zeros((TABLES, len(starts)), np.uint64)
    for walk in range(WALKS):
        at = starts.astype(np.int64)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for t, (w, steps) in enumerate(PLAN):
            if w == walk:
                for i, step in enumerate(steps):
                    wanted.setdefault(step, []).append((t, i))
        for step in range(max(wanted) + 1):
            now = symbols[at]
            for t, i in wanted.get(step, ()):
                keys[t] += now * MIX[t, i]
            at += ((now >> np.uint64(walk * STEPS + step)) & np.uint64(1)).view(np.int64)
    return spread(keys)


def spread(keys: np.ndarray) -> np.ndarray:
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    return keys


def piece_keys(symbols: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the keys of all runs of so many symbols."""
    keys = np.zeros(len(symbols), np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        keys = keys[: max(0, len(symbols) - size + 1)] + symbols[size - 1 :] * PIECE_MIX[size - 1]
        if size in sizes:
            yield size, spread(keys.copy())


def pieces(n_words: int, most: int) -> list[tuple[int, int]]:
    """(start, size) of disjoint runs of words, one more than the allowed edits: one of them stays whole."""
    cuts = np.linspace(0, n_words, min(most + 1, n_words) + 1).astype(int).tolist()
    return [(a, min(b - a, MOST_PIECE)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Sorted:
    """Keys with an index of numbers; most keys that are not there are turned away by a table of bits."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, wanted: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(index into ``wanted``, numbers of the equal keys) where there are some."""
        maybe = np.flatnonzero(self.filter[wanted >> np.uint64(64 - FILTER_BITS)])
        if len(maybe):
            low = np.searchsorted(self.keys, wanted[maybe], "left")
            high = np.searchsorted(self.keys, wanted[maybe], "right")
            for i in np.flatnonzero(high > low).tolist():
                yield int(maybe[i]), self.order[low[i] : high[i]].tolist()


def best_match(item: list[int], text: list[int], most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edit distance of the whole item to any part of ``text`` and that part's end, if at most ``most``.

    ``anchored`` looks only at parts that begin where the text does.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, s in enumerate(item):
        peq[s] = peq.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for end, symbol in enumerate(text, 1):
        eq = peq.get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & full, (mh << 1) & full  # a match may start anywhere, unless it is anchored
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


def word_hashes() -> WordHashes:
    return WordHashes(seed=3, normal=normal_word)


class ItemIndex:
    """Keys of all walks from all places of a block of items, or of the pieces of shorter ones."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float):
        hashed = word_hashes()
        self.items = [(key, hashed.of(words(text))) for key, text in items]
        self.items = [(key, s) for key, s in self.items if len(s)]
        self.most = [int(max_edits * len(s)) for _, s in self.items]
        item, place, keys = [], [], []
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, symbols) in enumerate(self.items):
            if len(symbols) < PIECED:
                cut = pieces(len(symbols), self.most[n])
                found = dict(piece_keys(symbols, {size for _, size in cut}))
                for at, size in cut:
                    by_size.setdefault(size, []).append((n, at, int(found[size][at])))
                continue
            # From later places the walk could leave the item.
            places = np.arange(len(symbols) - STEPS // 2 + 1)
            padded = np.concatenate([symbols, np.zeros(HALO + 1, np.uint64)])
            keys.append(walk_keys(padded, places))
            item.extend([n] * len(places))
            place.extend(places.tolist())
        self.item, self.place = np.array(item, np.int32), np.array(place, np.int32)
        self.walks = [Sorted(k) for k in np.concatenate(keys, axis=1)] if keys else []
        self.pieces = {
            size: ([p[:2] for p in found], Sorted(np.array([p[2] for p in found], np.uint64)))
            for size, found in by_size.items()
        }

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in ``symbols``, place in the item that agrees with it, item), with repeats."""
        if self.walks:
            for known, keys in zip(self.walks, walk_keys(symbols, starts), strict=True):
                for i, numbers in known.find(keys):
                    for k in numbers:
                        yield int(starts[i]), int(self.place[k]), int(self.item[k])
        for size, keys in piece_keys(symbols, set(self.pieces)):
            places, known = self.pieces[size]
            for i, numbers in known.find(keys[starts]):
                for k in numbers:
                    n, place = places[k]
                    yield int(starts[i]), place, n

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches (item id, distance, start word, end word), one per item: the nearest."""
        hashed = worker_copy("benchmark words", word_hashes)
        each = [hashed.of(words(t)) for t in texts]
        filler = np.zeros(HALO + 1, np.uint64)
        symbols = np.concatenate([x for s in each for x in (s, filler)] or [filler])
        sizes = np.array([len(s) for s in each], np.int64)
        firsts = np.concatenate([[0], np.cumsum(sizes + len(filler))[:-1]]) if len(each) else np.zeros(0, np.int64)
        starts = np.concatenate([np.arange(f, f + n) for f, n in zip(firsts, sizes, strict=True)] or [firsts])
        checked: dict[tuple[int, int], set[int]] = {}
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for walked, place, n in self.candidates(symbols, starts):
            # The item may start before the document does, where its first words are missing.
            doc = int(np.searchsorted(firsts, walked, "right")) - 1
            at = max(walked - place, int(firsts[doc]))
            symbol_ids, most = self.items[n][1], self.most[n]
            # A shift by up to the allowed edits looks at the same words.
            near = checked.setdefault((doc, n), set())
            if at in near:
                continue
            near.update(range(at - most // 2, at + most // 2 + 1))
            low = max(0, at - int(firsts[doc]) - 2 * most)
            high = min(int(sizes[doc]), at - int(firsts[doc]) + len(symbol_ids) + 2 * most)
            hit = best_match(symbol_ids.tolist(), each[doc][low:high].tolist(), most)
            if hit:
                key, distance, end = self.items[n][0], hit[0], low + hit[1]
                # Backwards from its end, the match is as long as the text's edits make it.
                back = best_match(symbol_ids[::-1].tolist(), each[doc][low:end][::-1].tolist(), distance, anchored=True)
                start = end - back[1]
                if key not in found[doc] or distance < found[doc][key][0]:
                    found[doc][key] = (distance, start, end)
        return [sorted((k, *v) for k, v in f.items()) for f in found]


def item_blocks(items: DataFrame, item_id: str, text: str, block_items: int, max_edits: float) -> Iterator[ItemIndex]:
    """Indexes of all items, a bounded number at a time."""
    kept = items.select(F.col(f"`{item_id}`").try_cast("long").alias("item_id"), text_column(text).alias("text"))
    kept = kept.filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-kept.count() // block_items))
    for block in range(blocks):
        some = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct()
        index = ItemIndex([(r["item_id"], r["text"]) for r in some.toLocalIterator()], max_edits)
        if index.items:
            yield index


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", max_edits: float = MAX_EDITS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """doc_id, item_id, distance, n_item_words, start_word, end_word of every item in a document.

    The distance is counted in words; a document and an item give one row, the nearest match.
    ``start_word`` is the first word of that match, found by going backwards from its end.
    Documents with a NULL text, and items without words or without an id that is a whole number,
    match nothing; a document's id that is none is NULL.
    Repeated rows each give their matches; other columns are not read; an empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").try_cast("long").alias("doc_id"), text_column(text).alias("text"))
    schema = "doc_id long, item_id long, distance int, n_item_words int, start_word int, end_word int"
    out = spark.createDataFrame([], schema)
    for index in item_blocks(items, item_id, item_text, block_items, max_edits):
        shared = spark.sparkContext.broadcast(index)
        sizes = {key: len(s) for key, s in index.items}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, sizes=sizes) -> Iterator[pa.RecordBatch]:
            for batch in batched(batches):
                found = shared.value.search(batch.column(1).to_pylist())
                hits = [
                    (key, item, distance, sizes[item], start, end)
                    for key, matches in zip(batch.column(0).to_pylist(), found, strict=True)
                    for item, distance, start, end in matches
                ]
                names = ["doc_id", "item_id", "distance", "n_item_words", "start_word", "end_word"]
                columns = list(zip(*hits, strict=True)) or [[]] * 6
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )

        out = out.union(map_arrow(rows, run, schema))
    return out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_edits: float = MAX_EDITS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay as they are.

    Items without an id (also one that is not a whole number) match nothing, as in ``find_leaks``.
    """
    spark = docs.sparkSession
    (body,) = fresh_names(docs, "body")
    out = docs.withColumn(body, text_column(text))
    schema = out.schema
    for index in item_blocks(items, item_id, item_text, block_items, max_edits):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batched(batches):
                texts = batch.column(batch.schema.get_field_index(body)).to_pylist()
                clean = [not matches for matches in shared.value.search(texts)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = map_arrow(out, run, schema)
    return out.drop(body)
