"""Quality rules with the frequency of lines across documents, in built-in expressions only.

Lines are normalised (lower case, single spaces) and hashed.  The number of distinct
documents of a host that hold a line says whether it is boilerplate; such lines are taken
out, and a document that has lost too much is rejected.  The text is read once: per
document the base counts and the hashes of its lines are staged, and all further passes
read these.  Each document sends a line's hash once, sums are combined before they are
shuffled, and frequent lines are met by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, text_column

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
LINE_DOCS = 10
LINE_SHARE = 0.02
KEEP_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
POSITION_BITS = 24


def words_of(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D."""
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(line), "[\\x20\\x09-\\x0D]+", " "))


def line_entries(text: Column) -> Column:
    """Hash and number of words of each line that has a word."""
    lines = F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def repeated_words(df: DataFrame, found: str, name: str) -> DataFrame:
    """Add ``name``: words in 3-word windows that occur twice or more in the array ``found``.

    Window hashes with the position in the low bits are sorted as plain numbers; only
    windows whose short hash meets an equal one are compared by their full hash.
    """
    at = lambda i: F.get(found, i)
    full = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
    starts = F.when(F.size(found) >= 3, F.sequence(F.lit(0), F.size(found) - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(
        starts, lambda i: F.shiftleft(full(i), POSITION_BITS).bitwiseOR(i.cast("long"))
    )
    df = df.withColumn("_sorted", F.sort_array(packed))
    short = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    near = lambda x, i, step: F.coalesce(short(x) == short(F.get("_sorted", i + step)), F.lit(False))
    maybe = F.filter("_sorted", lambda x, i: near(x, i, -1) | near(x, i, 1))
    low = F.lit((1 << POSITION_BITS) - 1)
    df = df.withColumn("_maybe", F.array_sort(F.transform(maybe, lambda x: F.struct(
        full(x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).cast("int").alias("p")))))
    # Positions do not fit the low bits in texts of 2^24 words and more: compare all windows in full.
    every = F.array_sort(F.transform(starts, lambda i: F.struct(full(i).alias("h"), i.alias("p"))))
    df = df.withColumn("_maybe", F.when(F.size(found) < (1 << POSITION_BITS), F.col("_maybe")).otherwise(every))
    same = lambda x, i, step: F.coalesce(x["h"] == F.get("_maybe", i + step)["h"], F.lit(False))
    twice = F.filter("_maybe", lambda x, i: same(x, i, -1) | same(x, i, 1))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.transform(
        "_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))).cast("long")
    )
    df = df.withColumn(name, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop("_sorted", "_maybe", "_places")


def base_rules(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT) -> DataFrame:
    """Add the counts of one document's rules and ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    without = lambda drop: F.length(whole) - F.length(F.translate(whole, drop, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumns({
        "_words": words_of(whole),
        "word_chars": (F.length(whole) - without(SPACES)).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "_lines": F.transform(lines, lambda x: F.xxhash64(x)),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = repeated_words(df, "_words", "n_repeat_words").drop("_words", "_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    keep_share: float = KEEP_SHARE,
    min_words: int = MIN_WORDS,
    max_repeat_pct: int = MAX_REPEAT_PCT,
    with_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, lines removed, ``kept``.

    A line is boilerplate on a host if more than ``line_docs`` distinct documents of the
    host and more than ``line_share`` of them hold it.  ``kept`` is false if the base rules
    fail or less than ``keep_share`` of the words is left.  ``with_text`` adds the text
    without boilerplate lines as ``clean_text``.

    A NULL text counts as empty and fails the base rules (its clean text is NULL); a NULL
    host is a host of its own; rows with the same doc_id are judged one by one and count as
    one document in a line's frequency, rows without a doc_id each as one.  An empty table
    gives an empty result.  Extra columns are not read.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        text_column(host).alias("_host"),
        text_column(text).alias("_text"),
    ).withColumn("_row", F.monotonically_increasing_id())
    entries = rows.withColumn("_entries", line_entries(F.coalesce("_text", F.lit(""))))
    judged = base_rules(entries, "_text", min_words, max_repeat_pct)
    staged = stage(judged if with_text else judged.drop("_text"), "quality")

    # Documents of a host that hold a line: each document sends a line once.
    who = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("_row")).alias("row"))
    held = staged.select("_host", who.alias("who"), F.explode(F.array_distinct("_entries.h")).alias("h"))
    frequency = held.distinct().groupBy("_host", "h").agg(F.count("*").alias("n_docs"))
    hosts = staged.select("_host", who.alias("who")).distinct().groupBy("_host").agg(F.count("*").alias("n_host"))
    same_host = lambda a, b: a["_host"].eqNullSafe(b["_host"])
    counted = frequency.filter(F.col("n_docs") > line_docs)
    frequent = counted.join(hosts, same_host(counted, hosts)).filter(F.col("n_docs") > line_share * F.col("n_host"))
    frequent = frequent.select(counted["_host"], "h")

    lines = staged.select("_row", "_host", F.explode("_entries").alias("e")).select("_row", "_host", "e.h", "e.n")
    hit = lines.join(frequent, same_host(lines, frequent) & (lines["h"] == frequent["h"])).select("_row", lines["h"], "n")
    sums = [F.count("*").alias("_cut"), F.sum("n").alias("_lost")]
    if with_text:
        sums.append(F.collect_set("h").alias("_drop"))
    removed = hit.groupBy("_row").agg(*sums)
    out = staged.join(removed, "_row", "left").withColumns({
        "n_lines_removed": F.coalesce("_cut", F.lit(0)).cast("long"),
        "n_words_removed": F.coalesce("_lost", F.lit(0)).cast("long"),
    })
    enough = F.col("n_words") - F.col("n_words_removed") >= keep_share * F.col("n_words")
    out = out.withColumn("kept", ~F.col("base_failed") & enough)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
               "kept", "n_lines_removed", "n_words_removed"]
    if with_text:
        left = F.filter(
            F.split("_text", "\n"), lambda x: ~F.coalesce(F.array_contains("_drop", F.xxhash64(normal_line(x))), F.lit(False))
        )
        out = out.withColumn("clean_text", F.array_join(left, "\n"))
        columns.append("clean_text")
    return out.select(*columns)
