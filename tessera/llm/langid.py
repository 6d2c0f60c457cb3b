"""Language identification by words first, with back-off to character n-grams.

For each language the model holds the log frequency of its commonest words and of character
n-grams at word edges and inside.  A word of the model is scored by its frequencies; another
word falls back to its 4-grams, what is not covered to 3-grams, then pairs, then single
letters, each step at a discount.  A document's score is a softmax of its summed scores.

Counts come from grouped Spark jobs over a sample of labelled rows of documented size.  Every
label is learned; the model holds at most ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams of each,
and only what a language has met takes room.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import batched, fresh_names, map_arrow, ragged_take, stage, text_column, worker_copy

SAMPLE_PER_LANGUAGE = 4_000  # labelled rows to learn from, for each language, about
MAX_WORDS = 20_000  # for each language
MAX_GRAMS = 20_000  # for each language
MAX_LABELS = 100_000  # more labels are an error: they are hardly languages
MAX_ENTRIES = 8_000_000  # of a model, in all languages: a larger one is an error
SIZES = (4, 3, 2, 1)
BACKOFF = math.log(0.4)
UNKNOWN = "und"
REMEMBERED = 200_000  # tokens of few languages; of many, as many as fill SCORES
SCORES = 20_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept back from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters_of(token: str) -> str:
    """A token as the model knows it: lower case, letters only."""
    return (token if token.isalpha() else "".join(filter(str.isalpha, token))).lower()


def grams_of(word: str) -> Counter:
    """Character n-grams of a word between edge marks."""
    marked = f"^{word}$"
    return Counter(marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1))


class SparseRows:
    """Rows with a column for each language, of which only those above the floor are kept."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int, floor: float):
        order = np.argsort(rows, kind="stable")
        self.columns, self.values = columns[order], values[order]
        self.starts = np.searchsorted(rows[order], np.arange(n + 1))
        self.width, self.floor = width, floor

    def __getitem__(self, wanted) -> np.ndarray:
        """One row, or a table of several, with all columns."""
        at = np.atleast_1d(np.asarray(wanted, np.int64))
        out = np.full((len(at), self.width), self.floor)
        starts, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        cells = ragged_take(starts, sizes)
        out[np.repeat(np.arange(len(at)), sizes), self.columns[cells]] = self.values[cells]
        return out[0] if np.ndim(wanted) == 0 else out


class Model:
    """Log frequencies of words and n-grams: a row for each, a column for each language."""

    def __init__(self, words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        self.name = uuid.uuid4().hex
        self.languages = sorted(words)
        self.words, self.word_rows = self._table(words)
        self.grams, self.gram_rows = self._table(grams)
        self.floor = np.full(len(self.languages), math.log(1e-7))

    def _table(self, counts: dict[str, dict[str, int]]) -> tuple[dict[str, int], SparseRows]:
        names = sorted(set().union(*[c.keys() for c in counts.values()]))
        number = {name: i for i, name in enumerate(names)}
        met = [counts.get(lang, {}) for lang in self.languages]
        rows = np.array([number[name] for c in met for name in c], np.int64)
        columns = np.repeat(np.arange(len(met)), [len(c) for c in met])
        n = np.array([n for c in met for n in c.values()], np.float64)
        # Normalised over all names, so that few counts do not pass for high shares; what a language
        # has not met costs the same in all, so that a language with few rows does not win by it.
        totals = np.bincount(columns, n, len(met)) + 0.1 * max(len(names), 1)
        floor = float(np.log(0.1 / totals.max())) if len(n) else 0.0
        return number, SparseRows(rows, columns, np.log((n + 0.1) / totals[columns]), len(names), len(met), floor)

    def back_off(self, word: str) -> tuple[list[int], int]:
        """Known n-grams that cover the word, longest first, and how many steps down they are in all."""
        marked, known, found, steps = f"^{word}$", self.grams, [], 0
        open_places = (1 << len(marked)) - 1
        for step, n in enumerate(SIZES):
            covered = open_places
            for i in range(len(marked) - n + 1):
                here = ((1 << n) - 1) << i
                if covered & here and (row := known.get(marked[i : i + n])) is not None:
                    covered &= ~here
                    found.append(row)
                    steps += step
            open_places = covered
            if not open_places:
                break
        return found, steps

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word: its own log frequencies, or the mean of its n-grams with discounts."""
        out = np.tile(self.floor, (len(words), 1))
        own, own_rows, other, lengths, discounts, grams = [], [], [], [], [], []
        for i, word in enumerate(words):
            row = self.words.get(word)
            if row is not None:
                own.append(i)
                own_rows.append(row)
            else:
                found, steps = self.back_off(word)
                if found:
                    other.append(i)
                    lengths.append(len(found))
                    discounts.append(steps)
                    grams.extend(found)
        if own:
            out[own] = self.word_rows[own_rows]
        if other:
            firsts = np.cumsum([0, *lengths[:-1]])
            sums = np.add.reduceat(self.gram_rows[grams], firsts, axis=0) + BACKOFF * np.array(discounts)[:, None]
            out[other] = sums / np.array(lengths)[:, None]
        return out


class Scorer(dict):
    """Scores texts with a model; remembers the tokens it has met, up to a fixed number."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        # The last column says whether the token has a letter.
        self.rows = np.zeros((1024, len(self.model.languages) + 1))

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.new.append(token)
        return number

    def _learn(self) -> None:
        known = len(self) - len(self.new)
        while len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        words = [letters_of(t) for t in self.new]
        at = [i for i, w in enumerate(words) if w]
        rows = np.zeros((len(words), self.rows.shape[1]))
        if at:
            rows[at, :-1] = self.model.scores([words[i] for i in at])
            rows[at, -1] = 1.0
        self.rows[known : len(self)] = rows
        self.new = []

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each; ``und`` and 0 for a text without a letter."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self) > min(REMEMBERED, SCORES // (len(self.model.languages) + 1)):
            self.forget()
        numbers = []
        for text in texts:
            found = text.split() if text else []
            numbers.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if self.new:
            self._learn()
        return [self._judge(self.rows[at].sum(axis=0)) for at in numbers]

    def _judge(self, sums: np.ndarray) -> tuple[str, float]:
        total = sums[:-1]
        if not sums[-1]:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.model.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())


def scorer(model: Model) -> Scorer:
    """The scorer of a model, kept by each Python worker from task to task."""
    return worker_copy(f"scorer {model.name}", lambda: Scorer(model))


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
) -> Model:
    """Learn from rows that are not held out and have a language.

    About ``sample_per_language`` rows of each language are taken, by a hash of the row's id and
    text; of a language with fewer rows all are.  Every label is learned.  More than
    ``MAX_LABELS`` labels, or a model of more than ``MAX_ENTRIES`` counts, raise a ValueError.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), text_column(text).alias("text"), text_column(lang).alias("lang"))
    good = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    labels = stage(good.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    found = labels.count()
    if not found:
        return Model({}, {})
    if found > MAX_LABELS:
        raise ValueError(f"{found} labels: at most {MAX_LABELS} can be learned")
    spot = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    taken = good.join(labels, "lang").filter(spot < F.lit(float(sample_per_language)) / F.col("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, 512):
            words: dict[str, Counter] = {}
            for language, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(language, Counter()).update(content.split())
            out: list[tuple[str, bool, str, int]] = []
            for language, tokens in words.items():
                clean, grams = Counter(), Counter()
                for token, n in tokens.items():
                    if word := letters_of(token):
                        clean[word] += n
                for word, n in clean.items():
                    for gram, times in grams_of(word).items():
                        grams[gram] += n * times
                out.extend((language, True, w, n) for w, n in clean.items())
                out.extend((language, False, g, n) for g, n in grams.items())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "is_word", "item", "n"]
            )

    counted = map_arrow(taken.select("lang", "text"), count, "lang string, is_word boolean, item string, n long")
    sums = stage(counted.groupBy("lang", "is_word", "item").agg(F.sum("n").alias("n")), "language")
    order = Window.partitionBy("lang", "is_word").orderBy(F.desc("n"), "item")
    most = F.when(F.col("is_word"), max_words).otherwise(max_grams)
    kept = stage(sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most), "language-model")
    entries = kept.count()
    if entries > MAX_ENTRIES:
        raise ValueError(f"a model of {entries} counts: at most {MAX_ENTRIES} fit, lower max_words and max_grams")
    words: dict[str, dict[str, int]] = {r["lang"]: {} for r in labels.select("lang").collect()}
    grams: dict[str, dict[str, int]] = {lang: {} for lang in words}
    for batch in kept.select("lang", "is_word", "item", "n").toArrow().to_batches():
        for language, is_word, item, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            (words if is_word else grams)[language][item] = n
    return Model(words, grams)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score; only ``text`` is looked at.

    A NULL text, or one without a letter, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pred, score, body = fresh_names(docs, *names, "body")
    source = docs.withColumn(body, text_column(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(shared.value)
        for batch in batched(batches):
            at = batch.schema.get_field_index(body)
            found = judge.predict(batch.column(at).to_pylist())
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                [*[batch.schema.names[i] for i in kept], pred, score],
            )

    schema = docs.withColumns({pred: F.lit("").cast("string"), score: F.lit(0.0)}).schema
    return map_arrow(source, run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, with a model learned from ``docs``.

    A row without an id is never held out; without a usable label every text is ``und``.
    Repeated rows stay, extra columns are not read, an empty table gives an empty result.
    """
    model = train(docs, doc_id, text, lang)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"),
                       text_column(text).alias("text"))
    return predict(rows, model).drop("text")


def keep_identified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_score: float = 0.5
) -> DataFrame:
    """``docs`` without texts whose language is unknown or uncertain; all columns stay."""
    pred, score = fresh_names(docs, "lang_pred", "score")
    found = predict(docs, train(docs, doc_id, text, lang), text, (pred, score))
    sure = (F.col(pred) != UNKNOWN) & (F.col(score) >= least_score)
    return found.filter(sure).select(*[f"`{c}`" for c in docs.columns])
