"""Bars to model, metrics and gates: the training run as one chain of operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.layout import Layout
from barwright.operators.metrics import evaluate, quality_gate
from barwright.operators.models import fit, predict
from barwright.operators.prepare import fit_scaler, prepare_split
from barwright.schema import MODEL_FEATURES
from barwright.session import materialize


@dataclass
class TrainingRun:
    split: DataFrame
    scaler: DataFrame
    models: dict[str, PipelineModel]
    predictions: DataFrame
    metrics: DataFrame
    gates: DataFrame


def train_and_evaluate(
    bars: DataFrame,
    estimators: dict,
    features: list[str] = MODEL_FEATURES,
    test_size: float = 0.2,
    fit_on: str = "train",
    layout: Layout = Layout(),
) -> TrainingRun:
    """Fits iterate over the split table, which is written once, as its rows are numbered."""
    split = prepare_split(bars, test_size, layout)
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    scaler = materialize(fit_scaler(train if fit_on == "train" else split, features), "scaler")
    models = {name: fit(train, estimator, scaler, features) for name, estimator in estimators.items()}
    tables = [
        predict(m, test, name).select("series_id", "ts", "model", F.col("target").alias("y"), "score", "pred")
        for name, m in models.items()
    ]
    predictions = reduce(DataFrame.unionByName, tables)
    metrics = evaluate(predictions)
    return TrainingRun(split, scaler, models, predictions, metrics, quality_gate(metrics))
