"""Pinned schemas and the column lists shared by several modules."""

from __future__ import annotations

from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]

# The seventeen indicator outputs, in the order they are produced.
INDICATORS = [
    "volatility_5",
    "volatility_10",
    "returns",
    "log_returns",
    "rsi",
    "bb_upper",
    "bb_lower",
    "bb_position",
    "atr",
    "volume_sma",
    "volume_ratio",
    "momentum_5",
    "momentum_10",
    "high_low_ratio",
    "close_open_ratio",
    "body_size",
    "gap",
]

MODEL_FEATURES = PRICE_COLUMNS + INDICATORS

# Columns that are never features.
NOT_FEATURES = {"series_id", "ts", "target", "datetime", "unix_timestamp", "row_id", "n_rows", "split"}


def feature_columns(columns: list[str]) -> list[str]:
    """All columns but the keys, the label and the bookkeeping ones."""
    return [c for c in columns if c.lower() not in NOT_FEATURES]
