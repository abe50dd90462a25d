"""Metrics, ranking, gates and signals over rule-based predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.catalog.drift_queries import _board_sql
from barwright.catalog.inputs import (
    RULES,
    Registry,
    drift_pair,
    metrics_sql,
    predictions,
    predictions_sql,
    r,
    rounded,
    rs,
    table,
    wide_predictions,
    wide_predictions_sql,
)
from barwright.functions import rules
from barwright.operators import drift, scoring
from barwright.operators import metrics as met
from barwright.operators import ranking
from barwright.operators.layout import Layout
from barwright.operators.models import blend, ensemble
from barwright.session import materialize

REGISTRY = Registry()
query = REGISTRY.query

PRED = predictions_sql()
WITH_METRICS = f"WITH {PRED},{metrics_sql()}"
_metric_cols = ", ".join(r('"precision"' if m == "precision" else m, m) for m in met.METRICS)
_counts = ["tn", "fp", "fn", "tp"]


def all_metrics(spark, d) -> DataFrame:
    return materialize(met.evaluate(predictions(spark, d)), "metrics")


@query("a10_confusion_counts", f"{WITH_METRICS} SELECT model, tn, fp, fn, tp FROM confusion")
def _(spark, d):
    return met.confusion(predictions(spark, d))


@query(
    "a11_accuracy_precision_recall_f1",
    f"""{WITH_METRICS} SELECT model, tn, fp, fn, tp, {rs('accuracy')}, {r('"precision"', 'precision')}, {rs('recall', 'f1')} FROM metrics""",
)
def _(spark, d):
    return rounded(met.scores_from_confusion(met.confusion(predictions(spark, d))))


@query("a12_roc_auc", f"{WITH_METRICS} SELECT model, {rs('roc_auc')} FROM metrics")
def _(spark, d):
    return rounded(met.roc_auc(predictions(spark, d)))


_report_sql = f"""{WITH_METRICS},
cls AS (
  SELECT model, 'down' AS label, coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS p, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS rc,
         coalesce(2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE, 0) AS f, tn + fp AS support FROM confusion
  UNION ALL
  SELECT model, 'up', coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0),
         coalesce(2 * tp / nullif(2 * tp + fn + fp, 0)::DOUBLE, 0), tp + fn FROM confusion),
rep AS (
  SELECT * FROM cls
  UNION ALL SELECT model, 'macro avg', avg(p), avg(rc), avg(f), sum(support)::BIGINT FROM cls GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(p * support) / sum(support), sum(rc * support) / sum(support),
                   sum(f * support) / sum(support), sum(support)::BIGINT FROM cls GROUP BY model)
SELECT model, label, {r('p', 'precision')}, {r('rc', 'recall')}, {r('f', 'f1')}, support FROM rep"""


@query("a13_classification_report", _report_sql)
def _(spark, d):
    return rounded(met.classification_report(predictions(spark, d)))


@query(
    "a14_signal_statistics",
    f"""WITH {PRED},
last AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC, series_id DESC) <= 10)
SELECT model, count(*) FILTER (WHERE pred = 1) AS n_up, count(*) FILTER (WHERE pred = 0) AS n_down, {r('avg(score)', 'mean_score')},
       {r('min(score)', 'min_score')}, {r('max(score)', 'max_score')} FROM last GROUP BY model""",
)
def _(spark, d):
    """The last ten signals of every model."""
    by_model = Layout(keys=("model",), ties=("series_id",))
    return rounded(scoring.signal_statistics(ranking.last_rows_per_series(predictions(spark, d), 10, by_model), ["model"]))


@query(
    "a15_prediction_health",
    f"""WITH {PRED},
h AS (SELECT model, avg(pred) AS a, avg(score) AS m, stddev_pop(score) AS s FROM predictions GROUP BY model)
SELECT model, {r('a', 'positive_rate')}, {r('m', 'mean_score')}, {r('s', 'std_score')}, a > 0.1 AND a < 0.9 AS rate_ok,
       s > 0.05 AS spread_ok, m > 0.3 AND m < 0.7 AS mean_ok FROM h""",
)
def _(spark, d):
    return rounded(met.prediction_health(predictions(spark, d)))


@query("a20_f1_weights", f"{WITH_METRICS} SELECT model, {rs('f1')}, {r('f1 / sum(f1) OVER ()', 'weight')} FROM metrics")
def _(spark, d):
    return rounded(met.f1_weights(all_metrics(spark, d)))


_rates_sql = """
rates AS (
  SELECT CASE WHEN value < 10 THEN 'timeout' WHEN value < 50 THEN 'prediction' ELSE 'crash' END AS kind,
         count(*) / (SELECT count(*) FROM events)::DOUBLE AS rate FROM events WHERE event_type = 'error' GROUP BY 1)"""


def error_rates(spark, d) -> DataFrame:
    """Shares of all events that are errors, by the size of their value."""
    e = table(spark, d, "events")
    total = e.agg(F.count(F.lit(1)).cast("double")).scalar()
    kind = F.when(F.col("value") < 10, "timeout").when(F.col("value") < 50, "prediction").otherwise("crash")
    counts = e.where(F.col("event_type") == "error").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("kind", F.try_divide(F.col("n").cast("double"), total).alias("rate"))


@query("a22_error_total", f"WITH {_rates_sql} SELECT {r('sum(rate)', 'total_rate')}, sum(rate) > 0.05 AS over_limit FROM rates")
def _(spark, d):
    return rounded(met.error_total(error_rates(spark, d)))


@query(
    "t04_leaderboard",
    f"{WITH_METRICS} SELECT model, {rs('f1')}, row_number() OVER (ORDER BY f1 DESC, model)::INTEGER AS position FROM metrics",
)
def _(spark, d):
    return rounded(met.leaderboard(all_metrics(spark, d)).select("model", "f1", "position"))


@query("t04_best_model", f"{WITH_METRICS} SELECT model, {rs('f1')} FROM metrics ORDER BY metrics.f1 DESC, model LIMIT 1")
def _(spark, d):
    return rounded(met.best_model(all_metrics(spark, d)))


@query("m08_model_comparison", f"{WITH_METRICS} SELECT model, tn, fp, fn, tp, {_metric_cols} FROM metrics")
def _(spark, d):
    return rounded(met.evaluate(predictions(spark, d)))


@query(
    "m08_comparison_per_series",
    f"WITH {PRED},{metrics_sql('model, series_id')} SELECT model, series_id, tn, fp, fn, tp, {_metric_cols} FROM metrics",
)
def _(spark, d):
    return rounded(met.evaluate(predictions(spark, d), ["model", "series_id"]))


@query(
    "m07_weighted_blend",
    f"""{WITH_METRICS},
wt AS (SELECT model, f1 / sum(f1) OVER () AS w FROM metrics),
b AS (SELECT series_id, ts, y, rsi * (SELECT w FROM wt WHERE model = 'rsi') + contrarian * (SELECT w FROM wt WHERE model = 'contrarian')
        + band * (SELECT w FROM wt WHERE model = 'band') AS p FROM scored)
SELECT series_id, ts, y, {r('p', 'score')}, CAST(round(p, 6) > 0.5 AS INTEGER) AS pred FROM b""",
)
def _(spark, d):
    wide = wide_predictions(spark, d).withColumnsRenamed({n: f"p_{n}" for n in RULES})
    weights = met.f1_weights(all_metrics(spark, d))
    out = rounded(blend(wide, weights, list(RULES)).select("series_id", "ts", "y", "score"))
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


@query(
    "f15_fixed_weight_blend",
    f"""WITH {wide_predictions_sql()}, b AS (SELECT *, round(0.5 * rsi + 0.3 * contrarian + 0.2 * band, 6) + 0.0 AS p FROM scored)
SELECT series_id, ts, p AS score, CAST(p > 0.5 AS INTEGER) AS pred FROM b""",
)
def _(spark, d):
    p = F.round(rules.weighted_blend([(F.col(n), F.lit(w)) for n, w in zip(RULES, (0.5, 0.3, 0.2))]), 6)
    out = wide_predictions(spark, d).select("series_id", "ts", p.alias("score"))
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


@query(
    "f16_soft_vote",
    f"""WITH {wide_predictions_sql()}, b AS (SELECT *, round((rsi + contrarian + band) / 3, 6) + 0.0 AS p FROM scored)
SELECT series_id, ts, p AS score, CAST(p > 0.5 AS INTEGER) AS pred FROM b""",
)
def _(spark, d):
    wide = wide_predictions(spark, d).withColumnsRenamed({n: f"p_{n}" for n in RULES})
    out = rounded(ensemble(wide, list(RULES)).select("series_id", "ts", "score"))
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


_gates_sql = f"""{WITH_METRICS},
g(metric, minimum) AS (VALUES ('accuracy', 0.5::DOUBLE), ('f1', 0.3), ('roc_auc', 0.51), ('recall', 0.25), ('precision', 0.4)),
v AS (SELECT model, metric, value FROM (UNPIVOT (SELECT model, accuracy, f1, roc_auc, recall, "precision" FROM metrics)
        ON accuracy, f1, roc_auc, recall, "precision" INTO NAME metric VALUE value))
SELECT model, metric, {r('value')}, minimum, value >= minimum AS passed FROM v JOIN g USING (metric)"""


@query("m10_quality_gate", _gates_sql)
def _(spark, d):
    return rounded(met.quality_gate(all_metrics(spark, d)))


@query(
    "m11_baseline_gate",
    f"{WITH_METRICS} SELECT model, {rs('f1')}, f1 > 0.2514::DOUBLE * 1.1::DOUBLE AS passed, {r('(f1 - 0.2514) / 0.2514 * 100', 'improvement_pct')} FROM metrics",
)
def _(spark, d):
    return rounded(met.baseline_gate(all_metrics(spark, d)))


@query(
    "m12_rollback_decision",
    f"""WITH {PRED},{metrics_sql()},{_board_sql},{_rates_sql},
s AS (SELECT count(*) FILTER (WHERE is_drift) > 2 AS severe_drift FROM board),
e AS (SELECT sum(rate) > 0.05 AS high_error_rate FROM rates)
SELECT model, accuracy < 0.5 OR f1 < 0.3 AS poor_performance, severe_drift, high_error_rate,
       accuracy < 0.5 OR f1 < 0.3 OR severe_drift OR high_error_rate AS rollback FROM metrics, s, e""",
)
def _(spark, d):
    summary = drift.dashboard_summary(drift.dashboard_drift(*drift_pair(spark, d, shifted=True)))
    errors = met.error_total(error_rates(spark, d))
    return met.rollback_decision(met.evaluate(predictions(spark, d)), summary, errors)


_versions = f"(SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') AS version FROM predictions)"


@query(
    "m13_version_comparison",
    f"""WITH {PRED},{metrics_sql('model, version', _versions)},
v AS (UNPIVOT (SELECT model, version, f1, accuracy, roc_auc FROM metrics) ON f1, accuracy, roc_auc INTO NAME metric VALUE value),
c AS (SELECT *, lag(value) OVER (PARTITION BY model, metric ORDER BY version) AS previous FROM v)
SELECT model, version, metric, {rs('value', 'previous')}, value > previous AS improved FROM c""",
)
def _(spark, d):
    """Each week's metrics as a version of each model."""
    weekly = predictions(spark, d).withColumn("version", F.date_format(drift.week_start(F.col("ts")), "yyyy-MM-dd"))
    return rounded(met.compare_versions(met.evaluate(weekly, ["model", "version"]), by=["model"]))


# -- signals --------------------------------------------------------------------


_conf = "greatest(score, 1 - score) * 100"
_signal_sql = f"""CASE WHEN pred = 1 THEN 'UP' ELSE 'DOWN' END AS direction, round_even(score, 4) + 0.0 AS probability_up,
       round_even(1 - score, 4) + 0.0 AS probability_down, round_even({_conf}, 2) + 0.0 AS confidence,
       CASE WHEN {_conf} >= 70 THEN 'STRONG' WHEN {_conf} >= 60 THEN 'MODERATE' ELSE 'WEAK' END AS signal_strength"""


# Scores of two decimals less than the rounding digits keep clear of rounding ties.
_plain = "(SELECT * REPLACE (round(score, 3) + 0.0 AS score) FROM predictions)"


def _plain_predictions(spark, d):
    return predictions(spark, d).withColumn("score", F.round("score", 3))


@query("m14_batch_signals", f"WITH {PRED} SELECT series_id, ts, model, {_signal_sql} FROM {_plain}")
def _(spark, d):
    out = scoring.signals(_plain_predictions(spark, d))
    return out.select("series_id", "ts", "model", *scoring.SIGNAL_COLUMNS)


@query(
    "f07_signal_strength",
    f"WITH {PRED} SELECT model, CASE WHEN {_conf} >= 70 THEN 'STRONG' WHEN {_conf} >= 60 THEN 'MODERATE' ELSE 'WEAK' END AS signal_strength, count(*) AS n FROM {_plain} GROUP BY 1, 2",
)
def _(spark, d):
    strength = rules.signal_strength(rules.confidence_percent(F.col("score")))
    return _plain_predictions(spark, d).groupBy("model", strength.alias("signal_strength")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f08_batch_confidence_tag",
    f"WITH {PRED} SELECT series_id, ts, model, CASE WHEN pred = 1 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN score > 0.7 OR score < 0.3 THEN 'STRONG' ELSE 'WEAK' END AS confidence_tag FROM predictions",
)
def _(spark, d):
    return scoring.batch_report(predictions(spark, d)).select("series_id", "ts", "model", "direction", "confidence_tag")


_next_sql = f"""WITH {PRED},
n AS (SELECT *, CASE WHEN pred = 1 THEN score ELSE 1 - score END AS c FROM predictions
      QUALIFY row_number() OVER (PARTITION BY model, series_id ORDER BY ts DESC) = 1)
SELECT model, series_id, CASE WHEN pred = 1 THEN 'UP' ELSE 'DOWN' END AS direction, {r('c', 'confidence')},
       CASE WHEN c > 0.6 THEN 'STRONG' WHEN c > 0.55 THEN 'MODERATE' ELSE 'WEAK' END AS signal FROM n"""


@query("f09_next_period_signal", _next_sql)
def _(spark, d):
    p = predictions(spark, d)
    latest = p.groupBy("model", "series_id").agg(F.max_by("score", "ts").alias("score"), F.max_by("pred", "ts").alias("pred"))
    out = scoring.next_period(latest)
    return rounded(out.select("model", "series_id", "direction", "confidence", "signal"))


@query("f10_direction", f"WITH {PRED} SELECT model, CASE WHEN pred = 1 THEN 'UP' ELSE 'DOWN' END AS direction, count(*) AS n FROM predictions GROUP BY 1, 2")
def _(spark, d):
    return predictions(spark, d).groupBy("model", rules.direction(F.col("pred")).alias("direction")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f11_half_even_rounding",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8.0::DOUBLE, 2) + 0.0 AS eighths, round_even(l_quantity / 2.0::DOUBLE, 0) + 0.0 AS halves FROM lineitem",
)
def _(spark, d):
    """Eighths at two digits and halves at none meet exact ties."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rules.round_half_even(q / 8.0, 2).alias("eighths"),
        rules.round_half_even(q / 2.0, 0).alias("halves"),
    )


