"""The registered queries against their SQL, and the guard around the package."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from poolwatch.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = contract.queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    told = lambda x: f"{x:.9f}" if isinstance(x, float) else str(x)
    rows = lambda data: sorted(tuple(map(told, r)) for r in data)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


def test_one_query_per_operator():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 1 + len(QUERIES)))
    assert set(names) == set(QUERIES) and "pipeline" in contract.queries()


def test_the_rest_imports_without_the_package(tmp_path):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, check=True, text=True)
    left = len(contract.queries()) - len(QUERIES) - 1
    assert done.stdout.split() == [str(left), "False"]
