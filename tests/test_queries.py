"""All registered queries against their SQL on the smallest tables; the entry point with and without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, small, tmp_path, name):
    __spark_entry__.queries()[name](spark, small).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = con.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    assert canonical(got) == canonical(con.sql(__spark_entry__.oracle_sql()[name]).df())


def test_oracles_are_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_text_operators(tmp_path):
    shutil.copytree(REPO / "lamina", tmp_path / "lamina", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'order_layers' in q and not any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline'); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
