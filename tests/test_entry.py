import os
import subprocess
import sys
from pathlib import Path

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("p1_")])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_runs_where_the_subpackage_cannot_be_imported():
    """A module that only the training-data operators import is missing."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n[:2] in ('p1', 'p2') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
