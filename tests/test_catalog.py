"""Registered queries against their SQL twins on the smallest tables.

A sample of the families by default; all of them with BARWRIGHT_FULL=1.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "a02_class_balance",
    "a03_describe",
    "d02_ks_raw",
    "d05_psi_reference_range",
    "d09_summary",
    "f11_half_even_rounding",
    "k01_write_split",
    "m08_model_comparison",
    "p12_audit_search",
    "s02_parse_timestamps",
    "t08_repeatable_sample",
    "w13_indicator_set_split_buckets",
    "w23_exponential_averages",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("BARWRIGHT_FULL") else QUICK

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
