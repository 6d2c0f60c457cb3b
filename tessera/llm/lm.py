"""Masked pseudo-likelihood of texts under a small two-sided window network.

The network predicts a word's class from the ``SIDE`` words before and after it: each context
place has its own table of vectors, their sum goes through tanh and a softmax of two levels,
the class's group and the class inside it, both fed by the context.  A class is one
of the commonest words of the corpus, or a bucket for all other words by their last letters.
A document's class score is the sum over its words of the log-probability of the word's class
given both sides.  Its token score adds to each the log share of the word among all words of
its class, so that it is of the word itself.

Everything the network knows is gathered by Spark: word counts over all documents, and
rounds in which documents are dealt by hash into shards of about ``SHARD_WORDS`` words.  In each
shard, in the order of the hashes, a copy is trained on every word, and the copies are averaged
in a two-level grouped sum.  So the weights depend on the rows, not on how they lie in files or
tasks.  Both grow with the corpus; only one set of weights and at most ``KNOWN`` of the commonest
words come to the driver.  The counts of these go to all tasks; other words, of which none is
frequent, are joined to their counts once for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, batched, map_arrow, ship, stage, text_column, words

CLASSES = 1024
COMMON = 896  # classes that are one word each; the others are buckets
GROUPS = 32  # of the classes, dealt in turn, so that each has common ones
SIDE = 2
HIDDEN = 16
EDGE = CLASSES  # stands before the first and after the last word
ROUNDS = 1
TRAIN_EVERY = 1  # all words; else one in so many, at a place that depends on the document and the round
STEP = 0.2
BATCH = 256
WIDE = 16384  # words of one step of the two-level network
RATE = 0.15
SHARD_WORDS = 4_000_000
COUNTED = 400_000
KNOWN = 100_000  # words whose counts go to all tasks; the counts of others are joined
FANIN = 64
SLICES = 48


class Vocabulary(dict):
    """Class of each word; remembers the words it has met, up to a fixed number."""

    def __init__(self, common: list[bytes]):
        super().__init__()
        self.common = {w: i for i, w in enumerate(common)}

    def __missing__(self, word: bytes) -> int:
        lower = word.translate(ASCII_LOWER)
        number = self.common.get(lower)
        if number is None:
            number = COMMON + xxhash.xxh64_intdigest(lower[-3:], 5) % (CLASSES - COMMON)
        self[word] = number
        return number

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) > COUNTED:
            self.clear()
        numbers = itemgetter(*found)(self) if len(found) > 1 else [self[w] for w in found]
        return np.fromiter(numbers, np.int16, len(found))

    def classes(self, text: str | None) -> np.ndarray:
        return self.of(words(text))

    def sampled(self, text: str | None, first: int, every: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and classes of every so many-th word, without a look at words far from these."""
        found = words(text)
        at = range(first, len(found), every)
        if not len(at):
            return np.zeros((2 * SIDE, 0), np.int16), np.zeros(0, np.int16)
        near = [k for k in range(-SIDE, SIDE + 1)]
        last = len(found) - 1
        wanted = [found[min(max(p + k, 0), last)] for k in near for p in at]
        rows = self.of(wanted).reshape(len(near), len(at))
        place = np.arange(first, len(found), every) + np.array(near)[:, None]
        rows[(place < 0) | (place > last)] = EDGE
        return np.delete(rows, SIDE, axis=0), rows[SIDE]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (lower case, A-Z only) of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
    # White space before the first or after the last word leaves an empty one there.
    filled = pc.greater(pc.binary_length(found), 0)
    before = np.cumsum(np.append(0, filled.to_numpy(zero_copy_only=False)))
    return found if before[-1] == len(found) else found.filter(filled), np.diff(before[ends - ends[0]])


class Ranks:
    """Class and rank (by count) of many words at once; words that are not among the ranked share the last number."""

    def __init__(self, common: list[bytes], ranked: list[bytes] | None = None):
        # The commonest words come first in both, so their rank is their class.
        self.common, self.ranked = len(common), pa.array(common if ranked is None else ranked, pa.binary())

    def of(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of words in lower case."""
        ranks = pc.fill_null(pc.index_in(found, value_set=self.ranked), len(self.ranked)).to_numpy()
        classes, rest = ranks.astype(np.int16), np.flatnonzero(ranks >= self.common)
        ends = pc.binary_slice(found.take(pa.array(rest)), -3).dictionary_encode()
        buckets = [COMMON + xxhash.xxh64_intdigest(e, 5) % (CLASSES - COMMON) for e in ends.dictionary.to_pylist()]
        classes[rest] = np.array(buckets, np.int16)[ends.indices.to_numpy()]
        return classes, ranks


def all_contexts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes around every word of texts of these sizes, which lie one after another."""
    gaps = SIDE * np.arange(1, len(sizes) + 1)
    at = np.arange(len(classes)) + np.repeat(gaps, sizes)
    padded = np.full(len(classes) + SIDE * (len(sizes) + 1), EDGE, np.int16)
    padded[at] = classes
    return np.stack([padded[at + k] for k in range(-SIDE, SIDE + 1) if k])


class Network:
    """Weights as one float32 vector with named parts."""

    SHAPES = {"context": (2 * SIDE, CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "prior": (CLASSES,)}

    def __init__(self, flat: np.ndarray | None = None, prior: np.ndarray | None = None, seed: int = 9):
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        rng = np.random.default_rng(seed)
        self.flat = np.array(flat, np.float32) if flat is not None else rng.normal(0, 0.1, size).astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        if prior is not None:
            self.prior[:] = prior
            self.bias[:] = 0

    @staticmethod
    def contexts(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Classes around the places ``at``; the word itself is masked."""
        padded = np.concatenate([np.full(SIDE, EDGE), classes, np.full(SIDE, EDGE)])
        moves = [k for k in range(-SIDE, SIDE + 1) if k]
        return np.stack([padded[at + SIDE + k] for k in moves])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.context[0][context[0]]
        for k in range(1, 2 * SIDE):
            total += self.context[k][context[k]]
        total += self.bias
        return np.tanh(total, out=total)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target), np.float64)
        # tanh is at most 1, so this bounds all scores; without a risk of overflow no maximum is taken.
        bounded = float((np.abs(self.prior) + np.abs(self.out).sum(axis=0)).max()) < 60
        for k in range(0, len(target), 1024):
            part, goal = context[:, k : k + 1024], target[k : k + 1024]
            scores = self.hidden(part) @ self.out
            scores += self.prior
            picked = scores[np.arange(len(goal)), goal]
            if not bounded:
                top = scores.max(axis=1)
                scores -= top[:, None]
                picked = picked - top
            np.exp(scores, out=scores)
            out[k : k + 1024] = picked - np.log(scores.sum(axis=1))
        return out

    def train(self, context: np.ndarray, target: np.ndarray, step: float) -> None:
        """Plain gradient steps over small batches."""
        for k in range(0, len(target), BATCH):
            part, goal = context[:, k : k + BATCH], target[k : k + BATCH]
            hidden = self.hidden(part)
            scores = hidden @ self.out + self.prior
            scores -= scores.max(axis=1, keepdims=True)
            error = np.exp(scores)
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(goal)), goal] -= 1.0
            back = (error @ self.out.T) * (1 - hidden * hidden)
            rate = step / len(goal)
            self.out -= rate * (hidden.T @ error)
            self.prior -= rate * error.sum(axis=0)
            self.bias -= rate * back.sum(axis=0)
            # A context word's vector is met rarely: its step is not divided by the batch.
            cells = ((np.arange(2 * SIDE)[:, None] * (CLASSES + 1) + part)[:, :, None] * HIDDEN + np.arange(HIDDEN)).ravel()
            moved = np.bincount(cells, np.broadcast_to(back, (2 * SIDE, *back.shape)).ravel(), self.context.size)
            self.context -= (step / 8 * moved).reshape(self.context.shape).astype(np.float32)


class TwoLevel(Network):
    """The same with a softmax over groups of classes, then over the classes of the word's group."""

    SIZE = CLASSES // GROUPS
    SHAPES = {
        "context": (2 * SIDE, CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "upper": (HIDDEN, GROUPS), "first": (GROUPS,),
        "lower": (GROUPS, HIDDEN, CLASSES // GROUPS), "second": (GROUPS, CLASSES // GROUPS),
    }

    def __init__(self, flat: np.ndarray | None = None, prior: np.ndarray | None = None, seed: int = 9):
        super().__init__(flat, None, seed)
        self.squares = None
        if prior is not None:
            self.bias[:] = 0
            chance = np.exp(prior.reshape(self.SIZE, GROUPS).T)  # class c is number c // GROUPS of group c % GROUPS
            whole = chance.sum(axis=1)
            self.first[:], self.second[:] = np.log(whole), np.log(chance / whole[:, None])

    def bounded(self) -> bool:
        """Whether no score can be so large that its exponential overflows (tanh is at most 1)."""
        upper = np.abs(self.upper).sum(axis=0) + np.abs(self.first)
        return float(upper.max()) < 60 and float((np.abs(self.lower).sum(axis=1) + np.abs(self.second)).max()) < 60

    @staticmethod
    def _shares(scores: np.ndarray, bounded: bool) -> np.ndarray:
        """Softmax of each column, in place: one column per word, so that sums run along memory."""
        if not bounded:
            scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores *= 1 / scores.sum(axis=0)
        return scores

    @staticmethod
    def _log_share(scores: np.ndarray, row: np.ndarray, each: np.ndarray, bounded: bool) -> np.ndarray:
        """Logarithm of one row's share in each column."""
        if not bounded:
            scores -= scores.max(axis=0)
        picked = scores[row, each]
        np.exp(scores, out=scores)
        return picked - np.log(scores.sum(axis=0))

    def columns(self, context: np.ndarray) -> np.ndarray:
        """Hidden values, one column per word."""
        total = self.context[0].take(context[0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.context[k].take(context[k], axis=0)
        total += self.bias
        return np.tanh(total.T, order="C")

    @staticmethod
    def _by_group(context: np.ndarray, target: np.ndarray):
        """Words sorted by the group of their class, and the run of each group."""
        group = (target % GROUPS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        runs = [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
        return order, context.take(order, axis=1), group[order], (target // GROUPS)[order], runs

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        out, bounded = np.empty(len(target), np.float64), self.bounded()
        for k in range(0, len(target), WIDE):
            order, part, group, number, runs = self._by_group(context[:, k : k + WIDE], target[k : k + WIDE])
            hidden, each = self.columns(part), np.arange(len(order))
            found = self._log_share(self.upper.T @ hidden + self.first[:, None], group, each, bounded)
            for g, a, b in runs:
                scores = self.lower[g].T @ hidden[:, a:b] + self.second[g][:, None]
                found[a:b] += self._log_share(scores, number[a:b], each[: b - a], bounded)
            out[k + order] = found
        return out

    def train(self, context: np.ndarray, target: np.ndarray, step: float) -> None:
        """Gradient steps over batches, each weight's step shrunk by the squares it has met."""
        if self.squares is None:
            self.squares = TwoLevel(np.full_like(self.flat, 1e-6))
        at = self.context.size  # the other weights all move in every step
        change, past = TwoLevel(np.zeros_like(self.flat)), self.squares
        for k in range(0, len(target), WIDE):
            order, part, group, number, runs = self._by_group(context[:, k : k + WIDE], target[k : k + WIDE])
            hidden, each, scale = self.columns(part), np.arange(len(order)), np.float32(1 / len(order))
            bounded = self.bounded()
            error = self._shares(self.upper.T @ hidden + self.first[:, None], bounded)
            error[group, each] -= 1
            change.flat[at:] = 0
            change.upper[:] = hidden @ error.T
            change.first[:] = error.sum(axis=1)
            back = self.upper @ error
            for g, a, b in runs:
                error = self._shares(self.lower[g].T @ hidden[:, a:b] + self.second[g][:, None], bounded)
                error[number[a:b], each[: b - a]] -= 1
                change.lower[g] = hidden[:, a:b] @ error.T
                change.second[g] = error.sum(axis=1)
                back[:, a:b] += self.lower[g] @ error
            hidden *= hidden
            back *= np.subtract(1, hidden, out=hidden)
            change.bias[:] = back.sum(axis=1)
            for place in range(2 * SIDE):
                sort = np.argsort(part[place], kind="stable")
                found = part[place][sort]
                starts = np.flatnonzero(np.diff(found, prepend=-1))
                moved = np.add.reduceat(back.take(sort, axis=1), starts, axis=1).T * scale
                rows = found[starts]
                past.context[place, rows] += moved * moved
                self.context[place, rows] -= step * moved / np.sqrt(past.context[place, rows])
            rest = change.flat[at:]
            rest *= scale
            past.flat[at:] += rest * rest
            self.flat[at:] -= step * rest / np.sqrt(past.flat[at:])


def count_words(rows: DataFrame) -> DataFrame:
    """word (lower case, A-Z only) and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            found = split_words(batch.column("text"))[0].value_counts()
            held.append(pa.Table.from_arrays([found.field("values"), found.field("counts")], ["word", "n"]))
            n += len(found)
            if n > 2 * COUNTED:
                held = [_add_counts(held)]
                n = held[0].num_rows
                if n > COUNTED:
                    yield from held.pop().to_batches()
                    n = 0
        if held:
            yield from _add_counts(held).to_batches()
        # The worker goes on to other tasks, without the memory of these tables.
        held = found = None
        pa.default_memory_pool().release_unused()

    return map_arrow(rows.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _add_counts(held: list[pa.Table]) -> pa.Table:
    if len(held) == 1:
        return held[0]
    sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])


def class_sizes(counts: DataFrame, common: list[bytes]) -> np.ndarray:
    """How many words of the corpus are in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Ranks(common), np.zeros(CLASSES, np.int64)
        for batch in batches:
            np.add.at(sums, known.of(batch.column("word"))[0], batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(sums)], ["class", "n"])

    sizes = np.zeros(CLASSES, np.int64)
    for r in map_arrow(counts, run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    return sizes


def train_network(
    rows: DataFrame, common: list[bytes], prior: np.ndarray, rounds: int, seed: int = 9, every: int = TRAIN_EVERY, total: int | None = None
) -> TwoLevel:
    """Trained on ``rows`` (doc_id, text) of ``total`` words (counted if it is not given)."""
    network = TwoLevel(prior=prior, seed=seed)
    spark = rows.sparkSession
    ship(spark)
    if total is None:
        total = count_words(rows).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(-(-total // SHARD_WORDS), 1)
    mark = F.xxhash64("doc_id", "text")
    dealt = (
        rows.select("doc_id", "text", mark.alias("mark"))
        .withColumn("shard", F.pmod("mark", F.lit(shards)))
        .repartitionById(int(shards), F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "mark", "doc_id")
    )
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((network.flat, common))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            flat, known = shared.value
            vocabulary, ranks, name, own, n, contexts, targets, held = Vocabulary(known), Ranks(known), None, None, 0, [], [], 0

            def learn():
                nonlocal contexts, targets, held, n
                if held:
                    target, context = np.concatenate(targets), np.concatenate(contexts, axis=1)
                    mixed = np.random.default_rng(n + turn).permutation(held)
                    own.train(context[:, mixed], target[mixed], RATE)
                    n += held
                contexts, targets, held = [], [], 0

            def close():
                learn()
                if n:
                    pieces = np.array_split(own.flat.astype(np.float64) * n, SLICES)
                    return _slices(range(SLICES), [name % FANIN] * SLICES, pieces, n)

            def examples(batch: pa.RecordBatch):
                """Contexts and classes of the words to learn, text by text."""
                if every == 1:
                    found, sizes = split_words(batch.column("text"))
                    classes, ends = ranks.of(found)[0], np.cumsum([0, *sizes]).tolist()
                    around = all_contexts(classes, sizes)
                    return ((around[:, a:b], classes[a:b]) for a, b in zip(ends, ends[1:]))
                pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                return (vocabulary.sampled(t, xxhash.xxh32_intdigest(f"{k} {t}", turn) % every, every) for k, t in pairs)

            for batch in batched(batches, 1024):
                for shard, (around, goal) in zip(batch.column("shard").to_pylist(), examples(batch), strict=True):
                    if shard != name:
                        if name is not None and (done := close()) is not None:
                            yield done
                        name, own, n = shard, TwoLevel(flat), 0
                    contexts.append(around)
                    targets.append(goal)
                    held += len(goal)
                    if held >= 8 * WIDE:
                        learn()
            if name is not None and (done := close()) is not None:
                yield done

        def add(found: pa.Table) -> pa.Table:
            # In a fixed order, so that the sums are the same every time.
            pairs = sorted(zip(found.column("n").to_pylist(), found.column("weights").to_pylist(), strict=True))
            total = sum(np.frombuffer(w, "<f8") for _, w in pairs)
            return pa.Table.from_batches([_slices([found.column("slice")[0].as_py()], [0], [total], sum(n for n, _ in pairs))])

        # Slices of the weights are summed apart, in two steps, so no task meets all weights of all shards.
        schema = "slice int, part int, weights binary, n long"
        some = map_arrow(dealt, fit, schema).groupBy("slice", "part").applyInArrow(add, schema)
        whole = sorted(some.groupBy("slice").applyInArrow(add, schema).collect(), key=lambda r: r["slice"])
        if not whole:
            break
        network = TwoLevel(np.concatenate([np.frombuffer(r["weights"], "<f8") / r["n"] for r in whole]).astype(np.float32))
    return network


def commonest(counts: DataFrame, known: int) -> tuple[list[tuple[bytes, int]], int]:
    """At most ``known`` (or ``COMMON``) words by count, then word, and a count that no other word exceeds.

    The cut is read off a histogram of a few hundred ranges of counts, so only the words
    above it, and for a small corpus ``COMMON`` more, come to the driver.
    """
    size = F.floor(F.log2("n") * 16).cast("int")
    bars = sorted(counts.groupBy(size.alias("bar")).count().collect(), key=lambda r: -r["bar"])
    bar, held = (bars[0]["bar"] + 1 if bars else 0), 0
    for r in bars:
        if held + r["count"] > known:
            break
        bar, held = r["bar"], held + r["count"]
    top = counts.filter(size >= bar).collect() if held else []
    if len(top) < COMMON:
        top = counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    words_of = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda p: (-p[1], p[0]))
    return words_of, words_of[-1][1] if words_of else 0


def _slices(names, parts: list[int], pieces: list[np.ndarray], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "slice": pa.array(list(names), pa.int32()), "part": pa.array(parts, pa.int32()),
        "weights": pa.array([p.astype("<f8").tobytes() for p in pieces], pa.binary()),
        "n": pa.array([n] * len(pieces), pa.int64()),
    })


def _times(found: pa.Array, text: np.ndarray, texts: int) -> pa.Array:
    """How often each word occurs in each text, as one list per text; ``text`` is the number of each word's text."""
    words_of = found.dictionary_encode()
    most = max(len(words_of.dictionary), 1)
    pairs, n = np.unique(text * most + words_of.indices.to_numpy(), return_counts=True)
    each = pa.StructArray.from_arrays([words_of.dictionary.take(pa.array(pairs % most)), pa.array(n, pa.int64())], ["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // most, np.arange(texts + 1)), pa.int32()), each)


def pseudo_likelihood(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, seed: int = 9, known: int = KNOWN
) -> DataFrame:
    """Scores of every row: doc_id, n_words, and sums (natural log) and means of two kinds.

    log_likelihood and mean_log_likelihood are of the words' classes, token_log_likelihood and
    mean_token_log_likelihood of the words: log P(class | both sides) + log(n(word) / n(class)).

    A text without words (NULL, empty, white space) has sums 0 and NULL means.  Repeated rows
    stay and each count in learning; rows without an id are scored too; extra columns are not
    read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"))
    spark = docs.sparkSession
    counts = stage(count_words(rows), "word-counts")
    top, most_left = commonest(counts, known)
    ranked, log_counts = [w for w, _ in top], np.log(np.array([n for _, n in top] + [1], np.float64))
    common = ranked[:COMMON]
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Start from the classes' own frequencies; the buckets share the other words evenly.
    own = np.array([n for _, n in top[:COMMON]] + [0] * (COMMON - len(common)), np.float64)
    rest = np.full(CLASSES - COMMON, (total - own.sum()) / (CLASSES - COMMON))
    prior = np.log((np.concatenate([own, rest]) + 1) / (total + CLASSES))
    network = train_network(rows, common, prior, rounds, seed, total=total)
    log_sizes = np.log(np.maximum(class_sizes(counts, common), 1))
    shared = spark.sparkContext.broadcast((network.flat, common, ranked, log_counts, log_sizes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known_common, known_words, logs, sizes_of = shared.value
        own, known = TwoLevel(flat), Ranks(known_common, known_words)
        row = TaskContext.get().partitionId() << 40
        for batch in batched(batches, 1024):
            found, sizes = split_words(batch.column("text"))
            classes, ranks = known.of(found)
            contexts, ends = all_contexts(classes, sizes), np.cumsum([0, *sizes])
            # A few texts are scored together, then added up text by text.
            cuts = [*ends[:-1:256].tolist(), len(classes)]
            scores = [own.log_probabilities(contexts[:, a:b], classes[a:b]) for a, b in zip(cuts, cuts[1:])]

            def sums(each):
                return pa.array(np.where(sizes > 0, np.add.reduceat(np.append(each, 0.0), ends[:-1]), 0.0))  # noqa: B023

            unknown = np.flatnonzero(ranks == len(known_words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(sizes)), pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 sums(np.concatenate(scores)), sums(logs[ranks] - sizes_of[classes]),
                 _times(found.take(pa.array(unknown)), np.searchsorted(ends, unknown, "right") - 1, len(sizes))],
                ["row", "doc_id", "n_words", "log_likelihood", "share", "others"],
            )
            row += len(sizes)

    # Staged, so that the numbers of the rows stay the same on both sides of the join.
    scored = stage(map_arrow(rows, score, "row long, doc_id long, n_words long, log_likelihood double, share double, "
                             "others array<struct<word: binary, times: long>>"), "scored")  # fmt: skip
    # No word that is not ranked exceeds the least ranked count, so no key of this join is hot.
    few = counts.filter(F.col("n") <= most_left)
    found = scored.select("row", F.inline("others")).join(few, "word")
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    token = F.col("log_likelihood") + F.col("share") + F.coalesce("more", F.lit(0.0))
    out = scored.drop("others").join(more, "row", "left").withColumn("token_log_likelihood", token)
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).alias(f"mean_{c}")
    return out.select("doc_id", "n_words", "log_likelihood", mean("log_likelihood"),
                      "token_log_likelihood", mean("token_log_likelihood"))
