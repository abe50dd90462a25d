"""Writing prepared data, metrics, drift results, models and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(prepared: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prepared rows as parquet, one folder for each split."""
    prepared.write.mode(mode).partitionBy("split").parquet(path)


def write_scaler(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    stats.write.mode(mode).parquet(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def drift_as_json(results: DataFrame) -> DataFrame:
    """One JSON document for each (method, feature), flags as real booleans."""
    return results.select(
        "method",
        "feature",
        F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("document"),
    )


def write_drift_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    drift_as_json(results).select("document").write.mode(mode).text(path)


def write_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def run_rows(metrics: DataFrame, run_id: str, experiment: str, params: dict[str, str]) -> DataFrame:
    """Long run table: one row for each model and metric."""
    names = [c for c in ("accuracy", "precision", "recall", "f1", "roc_auc") if c in metrics.columns]
    flat = [x for k, v in sorted(params.items()) for x in (F.lit(k), F.lit(str(v)))]
    params_map = F.create_map(*flat) if flat else F.expr("cast(map() as map<string,string>)")
    return metrics.unpivot("model", names, "metric", "value").select(
        F.lit(run_id).alias("run_id"),
        F.lit(experiment).alias("experiment"),
        "model",
        params_map.alias("params"),
        "metric",
        "value",
        F.current_timestamp().alias("logged_at"),
    )


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
