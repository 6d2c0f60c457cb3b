"""Every named query against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from oracles import oracle_sql
from tessera.plans.queries import QUERIES
from tests.compare import connect, differences, unwanted_nodes

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture
def staged_nodes(monkeypatch):
    """Unwanted plan nodes of every table written while a query is built."""
    found, write = [], DataFrameWriter.parquet

    def checked(self, *args, **kwargs):
        found.extend(unwanted_nodes(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", checked)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, staged_nodes, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, con, ORACLES[name]) == []
    assert staged_nodes + unwanted_nodes(df) == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["year", "Density"]
    assert df.count() > 0


def test_entry_works_without_the_optional_part():
    """In an interpreter of its own, as modules are imported once."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], out.stderr
