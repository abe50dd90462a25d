"""Sources, sinks, fitted models and the stream against batch."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barwright.operators import models, scoring, trees
from barwright.operators.layout import Layout
from barwright.operators.prepare import prepare, prepare_split, stratified_folds, time_split, with_class_weight_by
from barwright.plans.monitoring import drift_check, weekly_drift
from barwright.plans.training import train_and_evaluate
from barwright.schema import BAR_SCHEMA, INDICATORS, MODEL_FEATURES, feature_columns
from barwright.session import materialize, scratch_path
from barwright.sources import readers, sinks
from barwright.sources.bars import hourly_bars
from barwright.streaming.scoring import start_scoring, stream_rows


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in ("p", "q"):
        close = 100 + np.cumsum(rng.normal(0, 1, 260))
        for i, c in enumerate(close):
            o = float(c + rng.normal(0, 0.3))
            rows.append((s, i, o, float(max(o, c) + 1), float(min(o, c) - 1), float(c), float(rng.integers(1, 90))))
    df = spark.createDataFrame(rows, "series_id string, i int, open double, high double, low double, close double, volume double")
    ts = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("i"))).cast("timestamp_ntz")
    return df.select("series_id", ts.alias("ts"), "open", "high", "low", "close", "volume")


@pytest.fixture(scope="module")
def run(bars):
    return train_and_evaluate(
        bars,
        {
            "forest": models.random_forest(10, 4),
            "boosted": models.boosted_trees(3, 3, 0.1),
        },
    )


def test_hourly_bars_break_ties_by_id(spark):
    rows = [(3, "2024-01-01 00:10:00", 5.0), (1, "2024-01-01 00:10:00", 7.0), (2, "2024-01-01 00:50:00", 1.0), (4, "2024-01-01 00:50:00", 2.0), (5, "2024-01-01 02:00:00", 9.0)]
    e = spark.createDataFrame(rows, "event_id long, t string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    got = hourly_bars(e).orderBy("ts").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(7.0, 7.0, 1.0, 2.0, 4.0), (9.0, 9.0, 9.0, 9.0, 1.0)]
    plan = hourly_bars(e)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_reader_renames_and_cleans(spark):
    path = scratch_path(spark, "raw-csv")
    spark.createDataFrame([("2024-01-01 00:00:00", 1.0, 55.0, float("nan"))], "DATETIME string, OPEN double, RSI double, `VOLUME COIN` double").write.option("header", True).csv(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("DATETIME", T.StringType()), T.StructField("OPEN", T.DoubleType()), T.StructField("RSI", T.DoubleType()), T.StructField("VOLUME COIN", T.DoubleType())])
    df = readers.read_bars_csv(spark, path, schema, {"OPEN": "open", "VOLUME COIN": "volume"})
    assert df.columns == ["DATETIME", "open", "src_rsi", "volume"]
    row = readers.parse_timestamp(df, "DATETIME").collect()[0]
    assert row["volume"] is None and row["ts"].year == 2024


def test_csv_round_trip(spark, bars):
    path = scratch_path(spark, "bars-csv")
    bars.write.option("header", True).csv(path)
    back = readers.read_bars_csv(spark, path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in BAR_SCHEMA]
    assert back.exceptAll(bars).count() == 0 and back.count() == bars.count()


def test_feature_columns():
    assert feature_columns(["series_id", "ts", "close", "rsi", "TARGET", "row_id"]) == ["close", "rsi"]


@pytest.mark.slow
def test_training_run(run):
    assert {r["split"] for r in run.split.select("split").distinct().collect()} == {"train", "test"}
    n_test = run.split.where("split = 'test'").count()
    rows = run.metrics.collect()
    assert {r["model"] for r in rows} == {"forest", "boosted"}
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == n_test for r in rows)
    p = run.predictions.agg(F.min("score"), F.max("score")).collect()[0]
    assert 0 <= p[0] <= p[1] <= 1


@pytest.mark.slow
def test_saved_model_scores_the_same(spark, run):
    path = scratch_path(spark, "model")
    sinks.write_model(run.models["forest"], path)
    test = run.split.where("split = 'test'")
    a = scoring.score_rows(test, run.models["forest"]).select("series_id", "ts", *scoring.SIGNAL_COLUMNS)
    b = scoring.score_rows(test, readers.read_model(path)).select("series_id", "ts", *scoring.SIGNAL_COLUMNS)
    assert a.exceptAll(b).count() == 0


@pytest.mark.slow
def test_stream_equals_batch(spark, run):
    source, output, log = (scratch_path(spark, n) for n in ("in", "out", "log"))
    test = run.split.where("split = 'test'").select("series_id", "ts", *MODEL_FEATURES)
    test.repartition(6).write.parquet(source)
    model = run.models["boosted"]

    def score(rows):
        return scoring.score_rows(rows, model).select("series_id", "ts", *scoring.SIGNAL_COLUMNS)

    start_scoring(stream_rows(spark, source, test.schema, 2), score, output, log).awaitTermination()
    got = spark.read.parquet(output)
    assert got.count() == test.count() and got.exceptAll(score(test)).count() == 0
    start_scoring(stream_rows(spark, source, test.schema, 2), score, output, log).awaitTermination()
    assert spark.read.parquet(output).count() == test.count()


@pytest.mark.slow
def test_vectors_and_edge_inputs(spark, run):
    n = len(MODEL_FEATURES)
    rows = [(1, [1e6] * n), (2, [0.0] * n), (3, [1.0] * 10)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    good, bad = scoring.score_vectors(df, run.models["forest"], MODEL_FEATURES)
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and [r["id"] for r in bad.collect()] == [3]


@pytest.mark.slow
def test_ensemble_blend_and_importance(spark, run):
    test = run.split.where("split = 'test'")
    names = ["forest", "boosted"]
    wide = models.wide_scores(run.models, test)
    voted = models.ensemble(wide, names)
    assert voted.where(F.abs(F.col("score") - (F.col("p_forest") + F.col("p_boosted")) / 2) > 1e-12).count() == 0
    weights = spark.createDataFrame([("forest", 0.25), ("boosted", 0.75)], "model string, weight double")
    mixed = models.blend(wide, weights, names)
    assert mixed.where(F.abs(F.col("score") - (F.col("p_forest") * 0.25 + F.col("p_boosted") * 0.75)) > 1e-12).count() == 0
    imp = models.feature_importance(spark, run.models["forest"])
    assert imp.agg(F.sum("importance")).collect()[0][0] == pytest.approx(1.0)


@pytest.mark.slow
def test_nodes_give_the_fitted_probabilities(spark, run):
    test = run.split.where("split = 'test'")
    names = [f"scaled_{c}" for c in MODEL_FEATURES]
    for name, depth in (("forest", 4), ("boosted", 3)):
        model = run.models[name]
        nodes = materialize(trees.node_table(spark, model), "nodes")
        assert nodes.select("tree").distinct().count() == model.stages[-1].getNumTrees
        replay = trees.score_by_nodes(model.stages[0].transform(test), nodes, names, boosted=name == "boosted").select("series_id", "ts", "score", "pred")
        fitted = models.predict(model, test).select("series_id", "ts", F.col("score").alias("p"), F.col("pred").alias("c"))
        both = replay.join(fitted, ["series_id", "ts"])
        assert both.count() == test.count() and both.where((F.abs(F.col("score") - F.col("p")) > 1e-9) | (F.col("pred") != F.col("c"))).count() == 0
        whole = trees.cut_trees(nodes, depth=depth)
        assert whole.exceptAll(nodes).count() == 0
        stumps = trees.cut_trees(nodes, depth=1)
        assert stumps.where("left IS NOT NULL").count() == nodes.where("node = 0 AND left IS NOT NULL").count()
        large = trees.cut_trees(nodes, min_split=60)
        assert large.where("left IS NOT NULL AND n < 60").count() == 0
    few = trees.cut_trees(trees.node_table(spark, run.models["forest"]), trees=4)
    assert few.select("tree").distinct().count() == 4 and few.where("node = 0").agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


@pytest.mark.slow
def test_best_models_vote(spark, run):
    split = run.split.withColumn("late", F.col("row_id") >= F.col("n_rows") * 0.64)
    validation, test = split.where("late AND split = 'train'"), split.where("split = 'test'")
    board = {r["model"]: r["f1"] for r in models.validation_metrics(run.models, validation).collect()}
    voted, names = models.best_ensemble(run.models, validation, test, k=1)
    assert board[names[0]] == max(board.values())
    alone = models.predict(run.models[names[0]], test).select("series_id", "ts", F.col("score").alias("p"))
    assert voted.join(alone, ["series_id", "ts"]).where(F.abs(F.col("score") - F.col("p")) > 1e-12).count() == 0


@pytest.mark.slow
def test_search_over_several_estimators(spark, run):
    train = run.split.where("split = 'train'")
    forest, boosted = models.random_forest(4, 3), models.boosted_trees(2, 2, 0.1)
    spaces = {"forest": (forest, models.settings(forest, {"maxDepth": [2, 3]})), "boosted": (boosted, models.settings(boosted, {"stepSize": [0.1]}))}
    table, results = models.search(stratified_folds(train, 2), spaces, run.scaler, folds=2, fold_column="fold")
    rows = table.collect()
    assert len(rows) == 3 and set(results) == {"forest", "boosted"}
    assert [r["mean_f1"] for r in rows if r["is_best"]] == [max(r["mean_f1"] for r in rows)]
    assert len(models.settings(models.random_forest(), models.FOREST_SPACE)) == 24 and len(models.settings(models.boosted_trees(), models.BOOSTED_SPACE)) == 81


def test_weights_inside_folds(spark):
    rows = [(i, i % 3 % 2, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, target int, fold int")
    got = with_class_weight_by(df, ["fold"]).groupBy("fold", "target").agg(F.sum("weight").alias("w")).collect()
    assert len(got) == 4 and all(r["w"] == pytest.approx(7.5) for r in got)


def test_split_is_numbered_in_one_write(spark, bars):
    small = Layout(slice_bars=4, slices_per_bucket=4)
    once = prepare_split(bars, layout=small)
    twice = time_split(prepare(bars), layout=small)
    assert once.select(*twice.columns).exceptAll(twice).count() == 0 and once.count() == twice.count()
    assert "Exchange hashpartitioning(series_id" not in once._jdf.queryExecution().executedPlan().toString()


def test_feature_without_training_values_is_named(spark):
    stats = spark.createDataFrame([("a", None, None)], "feature string, mean double, std double")
    with pytest.raises(ValueError, match="no training row"):
        models.scaling_stage(stats, ["a"])


def test_extra_csv_columns_of_a_stated_type(spark):
    path = scratch_path(spark, "extra-csv")
    spark.createDataFrame([("1", "2"), ("x", "3")], "a string, b string").write.option("header", True).csv(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("b", T.IntegerType())])
    stated = readers.read_csv_by_name(spark, path, schema, extra_type="double")
    assert stated.dtypes == [("b", "int"), ("a", "double")] and sorted(r["a"] or 0 for r in stated.collect()) == [0, 1.0]
    assert readers.read_csv_by_name(spark, path, schema).dtypes == [("b", "int"), ("a", "string")]


def test_drift_json_has_booleans(spark, bars):
    results, summary = drift_check(bars.select("close", "volume"), bars.select((F.col("close") + 50).alias("close"), "volume"))
    path = scratch_path(spark, "drift")
    sinks.write_drift_json(results, path)
    docs = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert len(docs) == 6 and all(isinstance(d["is_drift"], bool) for d in docs)
    s = summary.collect()[0]
    assert s["drifted_features"] == ["close"] and s["recommended_action"] == "monitor"
    assert s["feature_drift_consensus"] == {"close": 2}


def test_weekly_drift_weeks_start_on_monday(bars):
    early = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    got = weekly_drift(bars.where(early), bars.where(~early), ["close"], methods=["psi"])
    assert sorted(r["week"] for r in got.collect()) == ["2024-01-01", "2024-01-08"]


def test_prepared_rows_are_complete(bars):
    p = prepare(bars)
    assert p.count() == 2 * (260 - 19)
    assert p.select([F.count_if(F.col(c).isNull()).alias(c) for c in INDICATORS]).collect()[0].asDict() == dict.fromkeys(INDICATORS, 0)


def test_tiny_sample_fractions(spark):
    from barwright.operators.prepare import sample_rows

    n = sample_rows(spark.range(500_000), "id", 0.00004).count()
    assert 5 <= n <= 45


def test_forest_keeps_rows_nodes(spark):
    """No pass walks the trees from their roots, and the fitted trees are those of walking."""
    rows = [(float(i % 37), float((i * i) % 101), i % 3 % 2) for i in range(400)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, target int"))
    kept, walked = models.random_forest(8, 6, weighted=False), models.random_forest(8, 6, weighted=False, node_ids=False)
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    trees_of = lambda rf: [t.toDebugString.split("\n", 1)[1] for t in rf.fit(df).trees]
    assert trees_of(kept) == trees_of(walked)
