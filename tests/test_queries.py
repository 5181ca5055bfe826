"""Every registered query next to its SQL, over whole tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from conftest import SF_DIR
from invoicelake.plans.catalog import QUERIES
from invoicelake.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLE[name])
    assert ok and rows > 0, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
