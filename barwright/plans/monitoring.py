"""Drift checks as whole jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.drift import detect_drift, drift_summary, week_start
from barwright.session import materialize


def drift_check(
    reference: DataFrame,
    current: DataFrame,
    features: list[str] | None = None,
    methods: Iterable[str] = ("ks", "psi", "ttest"),
    thresholds: dict[str, float] | None = None,
    preset: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The result table (a row per method and feature) and its one-row summary."""
    results = materialize(
        detect_drift(reference, current, features, methods, thresholds, preset), "drift"
    )
    return results, drift_summary(results)


def weekly_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    ts: str = "ts",
    methods: Iterable[str] = ("ks", "psi", "ttest"),
    preset: str | None = None,
) -> DataFrame:
    """Every calendar week of ``current`` against the reference, in one grouped job."""
    weeks = current.withColumn("__week", F.date_format(week_start(F.col(ts)), "yyyy-MM-dd"))
    return detect_drift(reference, weeks, features, methods, preset=preset, by="__week").withColumnRenamed("grp", "week")
