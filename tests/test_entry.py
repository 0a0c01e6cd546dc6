"""The driver's contract, with and without the training-data subpackage; oracle rows on a small scale."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    out = entry.queries()[name](spark, SF)
    found = [tuple(r) for r in out.collect()]
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        assert sorted(out.columns) == sorted(want.columns)
        assert rows(out.columns, found) == rows(want.columns, want.fetchall())


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "posolog"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/posolog/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    found = subprocess.run(["grep", "-rnE", r"posolog\.llm|from \.+llm|import llm", f"{ROOT}/posolog", "--include=*.py"], capture_output=True, text=True).stdout
    assert all(line.startswith(f"{ROOT}/posolog/llm/") for line in found.splitlines())
