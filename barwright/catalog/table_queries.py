"""Sources, sinks, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.catalog.inputs import (
    DRIFT_FEATURES,
    PSI_LABEL_SQL,
    RULES,
    Registry,
    bars_by_user,
    bars_sql,
    drift_pair,
    drift_sql,
    metrics_sql,
    predictions,
    predictions_sql,
    bars_by_type,
    prepared_by_type,
    psi_sql,
    r,
    rounded,
    rs,
    split_sql,
    table,
    wide_predictions,
    wide_predictions_sql,
)
from barwright.functions.rules import clip
from barwright.operators import metrics as met
from barwright.operators import prepare as prep
from barwright.operators.drift import detect_drift
from barwright.operators.ranking import append_batches
from barwright.session import materialize, scratch_path
from barwright.sources import readers, sinks

REGISTRY = Registry()
query = REGISTRY.query


@query("s01_read_bars_csv", f"WITH {bars_sql('user_id')} SELECT * FROM bars")
def _(spark, d):
    """Bars written as CSV with a header, read back with the declared schema."""
    path = scratch_path(spark, "bars-csv")
    bars_by_user(spark, d).write.option("header", True).csv(path)
    return readers.read_bars_csv(spark, path)


@query(
    "s02_parse_timestamps",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events",
)
def _(spark, d):
    """Times as text, those of one event type not a time at all."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("at "), text)).otherwise(text).alias("datetime")
    )
    return readers.parse_timestamp(raw, "datetime").select("event_id", "ts")


_pair_sql = f"""WITH {drift_sql()}
SELECT CASE WHEN is_ref THEN 'reference' ELSE 'current' END AS side, feature, count(*) AS n, {r('sum(value)', 'total', 2)} FROM long GROUP BY 1, 2"""


@query("s03_read_csv_pair", _pair_sql)
def _(spark, d):
    paths = [scratch_path(spark, "side-csv") for _ in range(2)]
    for side, path in zip(drift_pair(spark, d), paths):
        side.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in DRIFT_FEATURES])
    reference, current = readers.read_csv_pair(spark, *paths, schema)
    both = reference.withColumn("side", F.lit("reference")).unionByName(current.withColumn("side", F.lit("current")))
    long = both.unpivot("side", DRIFT_FEATURES, "feature", "value")
    return rounded(long.groupBy("side", "feature").agg(F.count("value").alias("n"), F.sum("value").alias("total")), 2)


@query("s04_read_split", f"WITH {split_sql()} SELECT series_id, ts, {rs('close', 'rsi')}, target FROM split_rows WHERE split = 'test'")
def _(spark, d):
    path = scratch_path(spark, "split")
    sinks.write_split(prep.prepare_split(bars_by_type(spark, d)), path)
    return rounded(readers.read_split(spark, path, "test").select("series_id", "ts", "close", "rsi", "target"))


@query(
    "k01_write_split",
    f"""WITH {split_sql()}
SELECT series_id, split, count(*) AS n_rows, sum(target)::BIGINT AS n_up, {r('sum(close)', 'sum_close', 4)} FROM split_rows GROUP BY 1, 2""",
)
def _(spark, d):
    path, scaler_path = scratch_path(spark, "split"), scratch_path(spark, "scaler")
    split = prep.prepare_split(bars_by_type(spark, d))
    sinks.write_split(split, path)
    sinks.write_scaler(prep.fit_scaler(readers.read_split(spark, path, "train")), scaler_path)
    out = readers.read_split(spark, path).groupBy("series_id", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("n_up"), F.sum("close").alias("sum_close")
    )
    return rounded(out, 4)


_metric_names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
_metric_cols = ", ".join(r('"precision"' if m == "precision" else m, m) for m in _metric_names)


@query("k02_write_metrics", f"WITH {predictions_sql()},{metrics_sql()} SELECT model, {_metric_cols} FROM metrics")
def _(spark, d):
    path = scratch_path(spark, "metrics-json")
    sinks.write_metrics_json(met.evaluate(predictions(spark, d)), path)
    schema = "model string, " + ", ".join(f"{m} double" for m in _metric_names)
    return rounded(spark.read.schema(schema).json(path))


@query(
    "k03_write_drift_json",
    f"WITH {drift_sql(True)},{psi_sql('combined')} SELECT feature, {r('psi')}, psi > 0.1 AS is_drift, {PSI_LABEL_SQL} AS interpretation FROM psi",
)
def _(spark, d):
    path = scratch_path(spark, "drift-json")
    reference, current = drift_pair(spark, d, shifted=True)
    sinks.write_drift_json(detect_drift(reference, current, DRIFT_FEATURES, ["psi"]), path)
    schema = "method string, feature string, psi double, is_drift boolean, interpretation string"
    back = spark.read.schema(schema).json(path)
    return rounded(back.select("feature", "psi", "is_drift", "interpretation"))


@query(
    "k05_run_table",
    f"""WITH {predictions_sql()},{metrics_sql()},
e AS (SELECT unnest(['first', 'second']) AS experiment),
l AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM metrics UNION ALL SELECT model, 'precision', "precision" FROM metrics
      UNION ALL SELECT model, 'recall', recall FROM metrics UNION ALL SELECT model, 'f1', f1 FROM metrics UNION ALL SELECT model, 'roc_auc', roc_auc FROM metrics)
SELECT experiment || '-1' AS run_id, experiment, model, 'score > 0.5' AS rule, metric, {r('value')} FROM e, l""",
)
def _(spark, d):
    path = scratch_path(spark, "runs")
    m = materialize(met.evaluate(predictions(spark, d)), "metrics")
    for experiment in ("first", "second"):
        sinks.append_runs(sinks.run_rows(m, f"{experiment}-1", experiment, {"rule": "score > 0.5"}), path)
    runs = spark.read.parquet(path)
    return rounded(runs.select("run_id", "experiment", "model", F.col("params")["rule"].alias("rule"), "metric", "value"))


@query(
    "a21_runs_per_experiment",
    f"""WITH {predictions_sql()}
SELECT series_id AS experiment, count(DISTINCT (series_id || model)) AS n_runs FROM predictions GROUP BY 1""",
)
def _(spark, d):
    """An experiment for each series, a run for each model scored on it."""
    m = met.evaluate(predictions(spark, d), ["series_id", "model"])
    tagged = m.unpivot(["series_id", "model"], _metric_names, "metric", "value").select(
        F.col("series_id").alias("experiment"), F.concat_ws("-", "series_id", "model").alias("run_id"), "model", "metric", "value"
    )
    return met.runs_per_experiment(tagged)


@query(
    "p12_audit_search",
    """SELECT ts AS "timestamp", event_id FROM events WHERE 1 + user_id % 4 = 2 AND event_type = 'error'""",
)
def _(spark, d):
    """Events as an audit log: four versions, errors are rollbacks."""
    e = table(spark, d, "events")
    log = e.select(
        F.col("ts").alias("timestamp"),
        "event_id",
        F.concat(F.lit("v"), (F.col("user_id") % 4 + 1).cast("string")).alias("version"),
        F.when(F.col("event_type") == "error", "rollback").otherwise("deploy").alias("action"),
    )
    return met.audit_search(log, "v2", "rollback").select("timestamp", "event_id")


@query(
    "t07_latest_version",
    f"""WITH g AS (SELECT event_type AS model, 1 + user_id % 15 AS v, avg(value) AS loss FROM events GROUP BY 1, 2)
SELECT model, max(v)::VARCHAR AS version, {r('arg_max(loss, v)', 'loss')} FROM g GROUP BY model""",
)
def _(spark, d):
    """Fifteen versions of each model, as text: '9' sorts after '15'."""
    registry = table(spark, d, "events").groupBy(
        F.col("event_type").alias("model"), (F.col("user_id") % 15 + 1).cast("string").alias("version")
    ).agg(F.avg("value").alias("loss"))
    return rounded(met.latest_version(registry))


@query(
    "u01_append_batches",
    f"""WITH {drift_sql()},
u AS (SELECT 0 AS batch, feature, value FROM long WHERE is_ref UNION ALL SELECT 1, feature, value FROM long WHERE NOT is_ref)
SELECT batch, feature, count(*) AS n, {r('avg(value)', 'mean')} FROM u GROUP BY 1, 2""",
)
def _(spark, d):
    both = append_batches(*drift_pair(spark, d)).unpivot("batch", DRIFT_FEATURES, "feature", "value")
    return rounded(both.groupBy("batch", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


@query(
    "f05_elementary_functions",
    f"""SELECT l_orderkey, l_linenumber, {r('ln(l_extendedprice)', 'log_price')}, {r('abs(l_quantity - 25)', 'distance')},
       {r('sqrt(l_quantity)', 'root')}, {r('sin(l_quantity)', 'wave')}, {r('greatest(0.02::DOUBLE, least(0.08::DOUBLE, l_discount))', 'clipped')}
FROM lineitem""",
)
def _(spark, d):
    q = F.col("l_quantity")
    return rounded(
        table(spark, d, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.ln("l_extendedprice").alias("log_price"),
            F.abs(q - 25).alias("distance"),
            F.sqrt(q).alias("root"),
            F.sin(q).alias("wave"),
            clip(F.col("l_discount"), 0.02, 0.08).alias("clipped"),
        )
    )


@query(
    "j02_align_models",
    f"WITH {wide_predictions_sql()} SELECT series_id, ts, y, rsi, contrarian, band FROM scored",
)
def _(spark, d):
    """Three tables of probabilities, one for each model, joined on their row key."""
    keys = ["series_id", "ts"]
    wide = wide_predictions(spark, d)
    first, *others = RULES
    out = wide.select(*keys, "y", first)
    for name in others:
        out = out.join(wide.select(*keys, name), keys)
    return out


