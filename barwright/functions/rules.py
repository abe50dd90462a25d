"""Threshold rules and small scalar expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero divisor, also in ANSI mode."""
    return F.try_divide(num, den)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def as_value(name: str) -> Column:
    """A numeric column as double with NaN read as missing."""
    return nan_to_null(F.col(name).cast("double"))


def psi_label(psi: Column) -> Column:
    # Stability index limits.
    return (
        F.when(psi < 0.05, "none")
        .when(psi < 0.1, "low")
        .when(psi < 0.25, "moderate")
        .when(psi.isNotNull(), "significant")
    )


def confidence_percent(p_up: Column) -> Column:
    return F.greatest(p_up, F.lit(1.0) - p_up) * 100


def signal_strength(confidence: Column) -> Column:
    # Percent limits of the served signal.
    return F.when(confidence >= 70, "STRONG").when(confidence >= 60, "MODERATE").otherwise("WEAK")


def batch_confidence(p_up: Column) -> Column:
    # Limits of the batch report.
    return F.when((p_up > 0.7) | (p_up < 0.3), "STRONG").otherwise("WEAK")


def next_signal(confidence: Column) -> Column:
    # Limits of the next-period signal, on a 0..1 confidence.
    return F.when(confidence > 0.6, "STRONG").when(confidence > 0.55, "MODERATE").otherwise("WEAK")


def direction(prediction: Column) -> Column:
    return F.when(prediction == 1, "UP").otherwise("DOWN")


def rsi_zone(rsi: Column) -> Column:
    return F.when((rsi > 30) & (rsi < 70), "neutral").otherwise("extreme")


def drift_action(n_drifted: Column) -> Column:
    # None, then up to three, then more.
    return F.when(n_drifted == 0, "none").when(n_drifted <= 3, "monitor").otherwise("retrain")


def drift_severity(n_drifted: Column) -> Column:
    # None, then up to two, then more.
    return F.when(n_drifted == 0, "none").when(n_drifted <= 2, "moderate").otherwise("significant")


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def soft_vote(*probabilities: Column) -> Column:
    return reduce(add, probabilities) / F.lit(float(len(probabilities)))


def weighted_blend(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(add, [p * w for p, w in pairs])
