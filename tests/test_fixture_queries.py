"""Every query that SQL can express gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_integer_ratio"):
        return str(int(v)) if float(v) == int(float(v)) else repr(round(float(v), 9))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in got.select(*columns).collect())
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_others_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without llm and corpus_pipeline.py still has the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/clearsift", tmp_path / "clearsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'retrieve_topk' in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
