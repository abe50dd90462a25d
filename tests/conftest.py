from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barwright.schema import BAR_SCHEMA, PRICE_COLUMNS  # noqa: E402
from barwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars from lists of closes; high/low/open follow unless given."""

    def make(close, series="s", start="2024-01-01", hours=None, **columns):
        n = len(close)
        first = datetime.fromisoformat(start)
        given = {
            "open": close,
            "high": [None if c is None else c + 1.0 for c in close],
            "low": [None if c is None else c - 1.0 for c in close],
            "close": close,
            "volume": [10.0] * n,
            **columns,
        }
        times = [first + timedelta(hours=h) for h in (range(n) if hours is None else hours)]
        rows = list(zip([series] * n, times, *(given[c] for c in PRICE_COLUMNS)))
        return spark.createDataFrame(rows, BAR_SCHEMA)

    return make


@pytest.fixture
def many_partitions(spark):
    """Keep every shuffle partition, so that small tables too are cut into several parts."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")
