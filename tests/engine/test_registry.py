"""The driver's contract, and the queries that are cheap at the least scale against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from oracle import connection, difference
from quantloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["s12_upsert", "c5_align_to_sessions", "j1_asof", "r1_wide_to_long", "b2_tied_bins", "p8_long_short", "rc6_rolling_spearman", "e3_ts_regression", "e5_fama_macbeth"])
def test_against_sql(spark, name):
    assert difference(spark, connection(DATA), DATA, registry.QUERIES[name], registry.ORACLES[name]) == ""
