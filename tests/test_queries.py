"""Every query next to its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    state, note = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert state in ("ok", "rows", "EMPTY"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
