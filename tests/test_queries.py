"""Every query against its SQL on the smallest tables, and the engine without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexigrid.plans import queries, workflows

QUERIES, SQL = queries.QUERIES | workflows.QUERIES, queries.SQL | workflows.SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    expected = con.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(expected.fetchall(), columns)


def test_entry_works_without_the_subpackage(tmp_path):
    """The entry module and the engine must import when the training-data folder isn't there."""
    root = Path(__file__).parents[1]
    for p in root.iterdir():
        if p.name not in ("lexigrid", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "lexigrid").mkdir()
    for p in (root / "lexigrid").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "lexigrid" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin:/usr/local/bin"} | __import__("os").environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES)), "False", "True"], done.stderr
