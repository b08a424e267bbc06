"""Every registered query against its SQL, and the three functions of the driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from oracle import DATA, difference
from plumbline import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, plans.QUERIES[name], plans.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_needs_no_session_to_name_its_queries():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
