from __future__ import annotations

import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron " * 4000

#: Missing values in every column, empty and blank texts, ties, repeated rows, a very long text.
ODD_ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \t\n\r ", "de", "a", 5),
    (None, "a row without an id", "en", "b", 19),
    (None, None, None, None, None),
    (7, LONG, "en", None, len(LONG)),
    (8, "... !!! 123 456", None, "b", 3),
    (8, "another text with the same id", "fr", "b", 3),
    (-9, "Größe naïve 日本語 <|endoftext|> don't\x85\x1c", "de", "a\x00", -1),
]
CLASHES = ("key", "chunk", "print", "body", "removed", "part", "score", "lang_pred", "size", "h", "n", "Row")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all odd cases and extra columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    fields = schema + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame([r + ("x",) * len(CLASHES) for r in ODD_ROWS], fields)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
