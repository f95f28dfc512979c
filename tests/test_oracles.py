"""Every registered query against its SQL (rows-only where there is none)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    same, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
