"""Registered queries agree with their SQL on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from salmoura.checks import all_entries
from salmoura.checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(all_entries()))
def test_query(spark, connection, name):
    entry = all_entries()[name]
    result = compare(spark, connection, FOLDER, entry.run, entry.sql)
    assert result["ok"], result.get("why")
    assert result["rows"] > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(all_entries()) <= set(contract.oracle_sql())
    assert contract.entry(spark).count() > 0


def test_no_single_task_writes_the_table_of_many_files(spark):
    first = all_entries()["c4_keep_first_many_files"].run(spark, FOLDER)
    assert len(first.inputFiles()) > 2
