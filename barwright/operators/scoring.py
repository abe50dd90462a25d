"""Probabilities into signals, in batch."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.rules import (
    batch_confidence,
    confidence_percent,
    direction,
    next_signal,
    round_half_even,
    signal_strength,
)
from barwright.operators.models import predict
from barwright.operators.prepare import split_by_width

SIGNAL_COLUMNS = ["direction", "probability_up", "probability_down", "confidence", "signal_strength"]


def signals(predictions: DataFrame) -> DataFrame:
    """The five served columns; strength is judged before rounding."""
    p, confidence = F.col("score"), confidence_percent(F.col("score"))
    return predictions.withColumns(
        {
            "direction": direction(F.col("pred")),
            "probability_up": round_half_even(p, 4),
            "probability_down": round_half_even(F.lit(1.0) - p, 4),
            "confidence": round_half_even(confidence, 2),
            "signal_strength": signal_strength(confidence),
        }
    )


def score_rows(prepared: DataFrame, model: PipelineModel) -> DataFrame:
    """Feature rows through the model (which scales them) to signals; works on streams too."""
    return signals(predict(model, prepared))


def score_vectors(vectors: DataFrame, model: PipelineModel, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an array ``features``: scored ones and those of the wrong length."""
    good, bad = split_by_width(vectors, len(features))
    named = good.select(
        *[c for c in vectors.columns if c != "features"],
        *[F.col("features")[i].alias(name) for i, name in enumerate(features)],
    )
    return score_rows(named, model), bad


def batch_report(predictions: DataFrame) -> DataFrame:
    """Direction and confidence tag of each row."""
    return predictions.withColumn("direction", direction(F.col("pred"))).withColumn(
        "confidence_tag", batch_confidence(F.col("score"))
    )


def next_period(latest: DataFrame) -> DataFrame:
    """Direction, confidence and signal of the latest prediction(s)."""
    confidence = F.when(F.col("pred") == 1, F.col("score")).otherwise(F.lit(1.0) - F.col("score"))
    return latest.withColumn("direction", direction(F.col("pred"))).withColumn("confidence", confidence).withColumn(
        "signal", next_signal(F.col("confidence"))
    )


def signal_statistics(recent: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of both directions and mean, min, max probability over the given rows, or each group of them."""
    return recent.groupBy(*by).agg(
        F.count_if(F.col("pred") == 1).alias("n_up"),
        F.count_if(F.col("pred") == 0).alias("n_down"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
