"""Bars from raw event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.clock import epoch_micros, floor_hour


def arrival_order(ts: Column, tie: Column) -> Column:
    """One fixed-width sort key for (time, tie breaker).

    A struct key would push ``min_by``/``max_by`` into a sort-based aggregate;
    a 128-bit decimal keeps the hash aggregate and its map-side combine.
    A missing tie breaker sorts before all others.
    """
    shift = F.expr("10000000000000000000BD")
    return (epoch_micros(ts).cast("decimal(17,0)") * shift + F.coalesce(tie.cast("decimal(19,0)"), F.lit(-(2**63)).cast("decimal(19,0)"))).cast("decimal(38,0)")


def hourly_bars(
    events: DataFrame,
    series: Column | None = None,
    ts: str = "ts",
    value: str = "value",
    tie: str = "event_id",
) -> DataFrame:
    """One OHLCV row per (series, hour) that has events; volume is the event count."""
    key = F.lit("ALL") if series is None else series.cast("string")
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    rows = events.select(
        key.alias("series_id"),
        floor_hour(F.col(ts)).alias("__hour"),
        v.alias("__v"),
        arrival_order(F.col(ts), F.col(tie)).alias("__order"),
    )
    return (
        rows.groupBy("series_id", F.col("__hour").alias("ts"))
        .agg(
            F.min_by("__v", "__order").alias("open"),
            F.max("__v").alias("high"),
            F.min("__v").alias("low"),
            F.max_by("__v", "__order").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )
