"""Queries over parts, documents and suppliers with keys and numbers of rows that the fixture tables do not reach."""

import os
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__
from test_fixture_queries import SF, TABLES, plain


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The smallest tables, with parts of keys around the powers of ten up to seven million."""
    folder, duck = str(tmp_path_factory.mktemp("large")), duckdb.connect()
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    os.unlink(f"{folder}/part.parquet")
    duck.sql(f"COPY (SELECT * REPLACE (p_partkey % 24 + b - 12 AS p_partkey) FROM '{SF}/part.parquet', (VALUES (100000), (1000000), (1048576), (7200000)) v(b) WHERE p_partkey < 24) TO '{folder}/part.parquet'")
    return SimpleNamespace(folder=folder, duck=duck)


@pytest.mark.parametrize("name", ["number_functions", "text_functions", "reply_functions", "array_functions"])
def test_functions_of_larger_keys(spark, large, name):
    """Doubles are shown without exponents, sizes come in megabytes and with grouped digits, numbers that are too long for a mask are no quotes."""
    got = __spark_entry__.queries()[name](spark, large.folder).select("function", "k", "result")
    expected = large.duck.sql(f"SELECT function, k, result FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(repr([plain(v) for v in r]) for r in got.collect()) == sorted(repr([plain(v) for v in r]) for r in expected)
