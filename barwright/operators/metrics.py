"""Classifier metrics, ranking and gates.

Predictions are long: (model, y, score, pred) with labels 0/1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barwright.operators.ordered import RANGE, range_parts

# Minimum quality and rollback limits.
QUALITY_GATES = {"accuracy": 0.50, "f1": 0.30, "roc_auc": 0.51, "recall": 0.25, "precision": 0.40}
ROLLBACK_ACCURACY, ROLLBACK_F1, ROLLBACK_ERRORS = 0.50, 0.30, 0.05
BASELINE_F1, BASELINE_FACTOR = 0.2514, 1.1
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def confusion(predictions: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    y, p = F.col("y"), F.col("pred")
    return predictions.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def scores_from_confusion(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _share(tp + tn, tp + tn + fp + fn),
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(tp * 2, tp * 2 + fp + fn),
        }
    )


def _ranked_counts(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Per model, in one pass: confusion counts and the pairs a random positive wins.

    Won pairs are the sum over scores of pos * (negatives below + tied
    negatives / 2).  Scores are counted first, then range-partitioned; each part
    gives its own sums, and the few parts are chained.
    """
    y, p = F.col("y"), F.col("pred")
    by_score = predictions.groupBy(*by, "score").agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 1) & F.col("score").isNotNull()).alias("pos"),
        F.count_if((y == 0) & F.col("score").isNotNull()).alias("neg"),
    )
    parts = range_parts(by_score, by, "score")
    w = Window.partitionBy(*by, RANGE).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("neg").over(w) - F.col("neg")
    counts = ["tn", "fp", "fn", "tp", "pos", "neg"]
    per_part = (
        parts.withColumn("won", F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
        .groupBy(*by, RANGE)
        .agg(F.sum("won").alias("won"), *[F.sum(c).alias(c) for c in counts])
    )
    prior = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    chained = per_part.withColumn("neg_before", F.coalesce(F.sum("neg").over(prior), F.lit(0)))
    won = F.col("won") + F.col("pos").cast("double") * F.col("neg_before")
    return chained.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], F.sum(won).alias("won"))


def _auc() -> Column:
    """Area under the ROC curve; NULL if only one class occurs."""
    return F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg").cast("double"))


def roc_auc(predictions: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    return _ranked_counts(predictions, by).select(*by, _auc().alias("roc_auc"))


def evaluate(predictions: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """One row per model: counts, accuracy, precision, recall, F1, ROC-AUC."""
    counts = _ranked_counts(predictions, by).withColumn("roc_auc", _auc())
    scores = scores_from_confusion(counts)
    return scores.select(*by, "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "roc_auc")


def classification_report(predictions: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """Per class precision, recall, F1, support, then the macro and the weighted row."""
    base = confusion(predictions, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def one(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            _share(hit, hit + wrong).alias("precision"),
            _share(hit, hit + missed).alias("recall"),
            _share(hit * 2, hit * 2 + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = base.select(
        *by, F.explode(F.array(one("down", tn, fn, fp), one("up", tp, fp, fn))).alias("c")
    ).select(*by, "c.*")
    values = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = classes.groupBy(*by).agg(
        F.lit("macro avg").alias("label"), *[F.avg(v).alias(v) for v in values], total.alias("support")
    )
    weighted = classes.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"),
        *[_share(F.sum(F.col(v) * F.col("support")), total).alias(v) for v in values],
        total.alias("support"),
    )
    return classes.unionByName(macro).unionByName(weighted)


def prediction_health(predictions: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """Positive rate, score mean and spread, and whether each is in its range."""
    return (
        predictions.groupBy(*by)
        .agg(
            F.avg(F.col("pred").cast("double")).alias("positive_rate"),
            F.avg("score").alias("mean_score"),
            F.stddev_pop("score").alias("std_score"),
        )
        .withColumns(
            {
                "rate_ok": (F.col("positive_rate") > 0.1) & (F.col("positive_rate") < 0.9),
                "spread_ok": F.col("std_score") > 0.05,
                "mean_ok": (F.col("mean_score") > 0.3) & (F.col("mean_score") < 0.7),
            }
        )
    )


def f1_weights(metrics: DataFrame) -> DataFrame:
    """Each model's share of the F1 sum; the table has one row per model."""
    total = F.sum("f1").over(Window.partitionBy())
    return metrics.select("model", "f1", F.try_divide(F.col("f1"), total).alias("weight"))


def leaderboard(metrics: DataFrame, order: str = "f1") -> DataFrame:
    """Models ranked by a metric; equal ones by name."""
    w = Window.partitionBy().orderBy(F.desc_nulls_last(order), "model")
    return metrics.withColumn("position", F.row_number().over(w))


def best_model(metrics: DataFrame, order: str = "f1") -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last(order), "model").limit(1).select("model", order)


def quality_gate(metrics: DataFrame, gates: dict[str, float] = QUALITY_GATES) -> DataFrame:
    """(model, metric, value, minimum, passed) for every gated metric."""
    limit = F.create_map(*[x for k, v in gates.items() for x in (F.lit(k), F.lit(v))])
    long = metrics.unpivot("model", list(gates), "metric", "value")
    return long.withColumn("minimum", limit[F.col("metric")]).withColumn(
        "passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))
    )


def baseline_gate(metrics: DataFrame, baseline: float = BASELINE_F1, factor: float = BASELINE_FACTOR) -> DataFrame:
    """Does F1 beat the baseline by the factor; improvement in percent."""
    return metrics.select(
        "model",
        "f1",
        (F.col("f1") > F.lit(baseline) * F.lit(factor)).alias("passed"),
        ((F.col("f1") - baseline) / F.lit(baseline) * 100).alias("improvement_pct"),
    )


def error_total(rates: DataFrame, threshold: float = ROLLBACK_ERRORS) -> DataFrame:
    total = F.coalesce(F.sum("rate"), F.lit(0.0))
    return rates.agg(total.alias("total_rate"), (total > threshold).alias("over_limit"))


def rollback_decision(metrics: DataFrame, dashboard_summary: DataFrame, errors: DataFrame) -> DataFrame:
    """Per model: the three reasons for a rollback and their disjunction.

    The drift and error inputs are one-row aggregates, read as scalars.
    """
    severity = dashboard_summary.select("severity").scalar()
    over = errors.select("over_limit").scalar()
    poor = (F.col("accuracy") < ROLLBACK_ACCURACY) | (F.col("f1") < ROLLBACK_F1)
    return (
        metrics.select("model", poor.alias("poor_performance"))
        .withColumn("severe_drift", severity == "significant")
        .withColumn("high_error_rate", over)
        .withColumn("rollback", F.col("poor_performance") | F.col("severe_drift") | F.col("high_error_rate"))
    )


def compare_versions(metrics: DataFrame, names: list[str] = ["f1", "accuracy", "roc_auc"], version: str = "version", by: list[str] = ()) -> DataFrame:
    """Each metric of a version beside the previous version's; a row per version and metric (and ``by``).

    Versions are ordered by their first number (9 before 10, v2 before v10), then as text.
    """
    number = F.try_to_number(F.regexp_extract(F.col(version).cast("string"), r"(\d{1,18})", 1), F.lit("9" * 18))
    w = Window.partitionBy(*by, "metric").orderBy(number.asc_nulls_first(), F.col(version).cast("string"))
    long = metrics.unpivot([*by, version], names, "metric", "value")
    return long.withColumn("previous", F.lag("value").over(w)).withColumn(
        "improved", F.col("value") > F.col("previous")
    )


def latest_version(registry: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """The registry row with the numerically largest version of each model."""
    rest = [c for c in registry.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.col("version").cast("int"))
    return registry.groupBy(*by).agg(newest.alias("r")).select(*by, "r.*")


def audit_search(log: DataFrame, version: str, action: str) -> DataFrame:
    return log.where((F.col("version") == version) & (F.col("action") == action))


def runs_per_experiment(runs: DataFrame) -> DataFrame:
    """Distinct runs of each experiment in the long run table."""
    return runs.groupBy("experiment").agg(F.count_distinct("run_id", "model").alias("n_runs"))
