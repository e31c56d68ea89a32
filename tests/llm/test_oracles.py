"""Operators that SQL can express, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratafill.llm.queries import LLM_ORACLES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None
