"""Every registered query outside llm against its SQL; the package without llm."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from barloom.plans import catalog
from compare import rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in sorted(catalog.oracle_sql()) if not n.startswith("vote_")])
def test_sql(spark, con, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def test_votes_are_registered():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and sum(n.startswith("vote_") for n in catalog.queries()) >= 13


def test_without_llm(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for x in ("barloom", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{here}/{x}") else shutil.copy)(f"{here}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "barloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(q.startswith('op') for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True)
