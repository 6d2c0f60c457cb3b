"""One named query for each of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.chat import render_maximal
from tessera.llm.common import table
from tessera.llm.decontam import find_leaks
from tessera.llm.langid import identify
from tessera.llm.lexical import lexical_search
from tessera.llm.lm import pseudo_likelihood
from tessera.llm.neighbours import nearest_neighbours
from tessera.llm.packing import pack_documents
from tessera.llm.phrases import mine_phrases
from tessera.llm.quality import quality_rules
from tessera.llm.simhash import simhash_groups
from tessera.llm.substring import dedup_substrings
from tessera.llm.urls import url_verdicts
from tessera.llm.wavelet import read_shards, write_shards

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that no longer one continues, rendered."""
    return render_maximal(table(spark, sf_dir, "conversations"))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's masked pseudo-log-likelihood under a network trained on all of them."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from wavelet-matrix files."""
    return read_shards(write_shards(table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document once 13-word windows of earlier ones are removed."""
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    return identify(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document, with lines frequent on its source removed."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the words where it stands."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of every language."""
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id 20 divides."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_chat_snapshots, op2_pseudo_likelihood, op3_token_shards, op4_substring_dedup, op5_simhash,
        op6_language_id, op7_url_rules, op8_quality_rules, op9_decontamination, op10_best_fit_packing, op11_lexical_search,
        op12_phrases, op13_nearest_neighbours,
    )
}
