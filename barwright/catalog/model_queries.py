"""Spark ML operators. What a fit gives has no SQL twin; that it is used rightly is compared with its table of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.catalog.inputs import (
    Registry,
    bars_by_type,
    bars_by_user,
    predictions,
    predictions_sql,
    r,
    rounded,
    split_sql,
)
from barwright.catalog.metric_queries import _conf
from barwright.functions.rules import direction, signal_strength, confidence_percent
from barwright.operators import models, scoring, trees
from barwright.operators import metrics as met
from barwright.operators import prepare as prep
from barwright.plans.training import train_and_evaluate
from barwright.schema import MODEL_FEATURES
from barwright.session import materialize, scratch_path
from barwright.sources import readers, sinks
from barwright.streaming.scoring import start_scoring, stream_rows

REGISTRY = Registry()
query = REGISTRY.query

METRIC_COLUMNS = ["model", "tn", "fp", "fn", "tp", *met.METRICS]


def _small_forest():
    return models.random_forest(trees=20, depth=5)


def _split(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, test and the scaler statistics of the training rows."""
    split = prep.prepare_split(bars_by_type(spark, d))
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    return train, test, materialize(prep.fit_scaler(train), "scaler")


@query("m01_random_forest_balanced")
def _(spark, d):
    run = train_and_evaluate(bars_by_type(spark, d), {"forest": models.random_forest(300, 8)})
    return rounded(run.metrics.select(*METRIC_COLUMNS))


@query("m01_random_forest_plain")
def _(spark, d):
    run = train_and_evaluate(bars_by_type(spark, d), {"forest": models.random_forest(100, 8, weighted=False)})
    return rounded(run.metrics.select(*METRIC_COLUMNS))


@query("m01_random_forest_by_user")
def _(spark, d):
    """The same forest on the bars of every user, which grow with the events."""
    run = train_and_evaluate(bars_by_user(spark, d), {"forest": models.random_forest(100, 8, weighted=False)})
    return rounded(run.metrics.select(*METRIC_COLUMNS))


@query("m02_boosted_trees")
def _(spark, d):
    run = train_and_evaluate(bars_by_type(spark, d), {"boosted": models.boosted_trees(200, 7, 0.05)})
    return rounded(run.metrics.select(*METRIC_COLUMNS))


@query("m03_grid_search")
def _(spark, d):
    """Two estimators over five stratified folds in time order, in one table; fewer settings than the whole spaces."""
    train, _, stats = _split(spark, d)
    forest, boosted = models.random_forest(20, 5), models.boosted_trees(5, 3, 0.1)
    spaces = {
        "forest": (forest, models.settings(forest, {"maxDepth": [3, 5], "minInstancesPerNode": [2, 4]})),
        "boosted": (boosted, models.settings(boosted, {"maxDepth": [2, 3], "subsamplingRate": [0.9]})),
    }
    table, _ = models.search(prep.stratified_folds(train, 5), spaces, stats, folds=5, fold_column="fold")
    return rounded(table)


@query("m04_time_ordered_cross_validation")
def _(spark, d):
    train, _, stats = _split(spark, d)
    forest = _small_forest()
    grid = models.settings(forest, {"maxDepth": [4]})
    result = models.grid_search(prep.stratified_folds(train, 3), forest, grid, stats, folds=3, fold_column="fold")
    return rounded(models.search_table(spark, result))


@query("m05_predict")
def _(spark, d):
    train, test, stats = _split(spark, d)
    model = models.fit(train, _small_forest(), stats)
    return rounded(models.predict(model, test, "forest").select("series_id", "ts", "target", "score", "pred"))


_scaled = [f"scaled_{c}" for c in MODEL_FEATURES]
_all_equal = f"WITH {split_sql()} SELECT count(*) AS n, 0::BIGINT AS n_different FROM split_rows WHERE split = 'test'"


def _replayed(spark, model, rows: DataFrame, boosted: bool = False) -> DataFrame:
    """``rows`` with ``replay``, the score by descent through the model's nodes."""
    scaled = model.stages[0].transform(rows)
    scored = trees.score_by_nodes(scaled, trees.node_table(spark, model), _scaled, boosted)
    return scored.select(*rows.columns, F.col("score").alias("replay"))


def _compared(scored: DataFrame, replayed: DataFrame) -> DataFrame:
    """How many rows there are in both, and how many differ in score."""
    both = scored.select("series_id", "ts", "score").join(replayed.select("series_id", "ts", "replay"), ["series_id", "ts"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("score") - F.col("replay")) > 1e-9).alias("n_different"))


@query("m05_forest_equals_its_nodes", _all_equal)
def _(spark, d):
    train, test, stats = _split(spark, d)
    model = models.fit(train, _small_forest(), stats)
    return _compared(models.predict(model, test), _replayed(spark, model, test))


@query("m02_boosted_equals_its_nodes", _all_equal)
def _(spark, d):
    train, test, stats = _split(spark, d)
    model = models.fit(train, models.boosted_trees(10, 3, 0.1), stats)
    return _compared(models.predict(model, test), _replayed(spark, model, test, boosted=True))


@query("s05_loaded_model_equals_nodes", _all_equal)
def _(spark, d):
    """A model saved and loaded against the nodes of the fitted one."""
    train, test, stats = _split(spark, d)
    path = scratch_path(spark, "model")
    model = models.fit(train, _small_forest(), stats)
    sinks.write_model(model, path)
    return _compared(models.predict(readers.read_model(path), test), _replayed(spark, model, test))


_pairs = list(zip(MODEL_FEATURES, MODEL_FEATURES[1:]))


@query(
    "m05_score_by_node_table",
    f"""WITH {split_sql()},
means AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in MODEL_FEATURES)} FROM split_rows WHERE split = 'train'),
sides AS (SELECT s.series_id, s.ts, s.split, s.target, t.tree, t.leaf FROM split_rows s, means m,
  LATERAL (SELECT unnest([{', '.join(f'{{tree: {i}, leaf: (s.{a} > m.{a})::INT * 2 + (s.{b} > m.{b})::INT}}' for i, (a, b) in enumerate(_pairs))}], recursive := true)) t),
leaves AS (SELECT tree, leaf, avg(target) AS value FROM sides WHERE split = 'train' GROUP BY ALL),
scored AS (SELECT series_id, ts, avg(coalesce(value, (SELECT avg(target) FROM split_rows WHERE split = 'train'))) AS score
  FROM sides LEFT JOIN leaves USING (tree, leaf) WHERE split = 'test' GROUP BY ALL)
SELECT series_id, ts, {r('score')}, (score > 0.5)::INTEGER AS pred FROM scored""",
)
def _(spark, d):
    """A forest fitted by aggregates, as a table of nodes; the SQL finds each row's leaves on its own."""
    split = prep.prepare_split(bars_by_type(spark, d))
    nodes = materialize(trees.mean_split_trees(split.where("split = 'train'"), MODEL_FEATURES), "nodes")
    scored = trees.score_by_nodes(split.where("split = 'test'"), nodes, MODEL_FEATURES, depth=2)
    return rounded(scored.select("series_id", "ts", "score", "pred"))


def _several_models(train, stats):
    return {
        "forest": models.fit(train, _small_forest(), stats),
        "plain_forest": models.fit(train, models.random_forest(20, 5, weighted=False, min_leaf=4), stats),
        "boosted": models.fit(train, models.boosted_trees(5, 3, 0.1), stats),
    }


def _validation(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training rows without, and only, their last fifth."""
    late = F.col("row_id") >= F.col("n_rows") * 0.64
    return train.where(~late), train.where(late)


@query("m06_soft_voting_ensemble")
def _(spark, d):
    """The two models that lead on the last fifth of the training rows vote on the test rows."""
    train, test, stats = _split(spark, d)
    early, late = _validation(train)
    voted, _ = models.best_ensemble(_several_models(early, stats), late, test, k=2)
    return rounded(met.evaluate(voted.withColumnRenamed("target", "y")).select(*METRIC_COLUMNS))


@query("m07_blend_of_fitted_models")
def _(spark, d):
    """Weights come from the last fifth of the training rows, not from the test rows."""
    train, test, stats = _split(spark, d)
    early, late = _validation(train)
    fitted = _several_models(early, stats)
    weights = models.validation_weights(fitted, late)
    out = models.blend(models.wide_scores(fitted, test), materialize(weights, "weights"), list(fitted))
    return rounded(met.evaluate(out.withColumnRenamed("target", "y")).select(*METRIC_COLUMNS))


@query("m09_feature_importance")
def _(spark, d):
    train, _, stats = _split(spark, d)
    return rounded(models.feature_importance(spark, models.fit(train, _small_forest(), stats)))


@query("t03_top_importance")
def _(spark, d):
    train, _, stats = _split(spark, d)
    return rounded(models.top_importance(spark, models.fit(train, _small_forest(), stats), 10))


@query("k04_save_model")
def _(spark, d):
    """Saved, loaded and used: the loaded model must score like the fitted one."""
    train, test, stats = _split(spark, d)
    path = scratch_path(spark, "model")
    model = models.fit(train, _small_forest(), stats)
    sinks.write_model(model, path)
    before = models.predict(model, test, "fitted")
    after = models.predict(readers.read_model(path), test, "loaded")
    both = before.unionByName(after)
    return rounded(both.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))


@query("s05_load_model")
def _(spark, d):
    train, test, stats = _split(spark, d)
    path = scratch_path(spark, "model")
    sinks.write_model(models.fit(train, _small_forest(), stats), path)
    return rounded(models.predict(readers.read_model(path), test, "loaded").select("series_id", "ts", "score", "pred"))


@query("m14_batch_scoring")
def _(spark, d):
    """Feature arrays of the users' bars scored by a model fitted on the event types' bars."""
    train, _, stats = _split(spark, d)
    model = models.fit(train, _small_forest(), stats)
    rows = prep.prepare(bars_by_user(spark, d))
    vectors = rows.select("series_id", "ts", F.array(*MODEL_FEATURES).alias("features"))
    scored, _ = scoring.score_vectors(vectors, model, MODEL_FEATURES)
    return scored.select("series_id", "ts", *scoring.SIGNAL_COLUMNS)


@query(
    "r01_stream_scoring",
    f"""WITH {predictions_sql()}
SELECT series_id, ts, model, score, CASE WHEN pred = 1 THEN 'UP' ELSE 'DOWN' END AS direction,
       CASE WHEN {_conf} >= 70 THEN 'STRONG' WHEN {_conf} >= 60 THEN 'MODERATE' ELSE 'WEAK' END AS signal_strength FROM predictions""",
)
def _(spark, d):
    """Prediction rows arrive as a file stream; the signal rules run on it."""
    source, output, checkpoint = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    predictions(spark, d).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def score(rows: DataFrame) -> DataFrame:
        return rows.select(
            "series_id",
            "ts",
            "model",
            "score",
            direction(F.col("pred")).alias("direction"),
            signal_strength(confidence_percent(F.col("score"))).alias("signal_strength"),
        )

    start_scoring(stream_rows(spark, source, schema, 4), score, output, checkpoint).awaitTermination()
    return spark.read.parquet(output)


@query("r01_stream_equals_nodes", _all_equal)
def _(spark, d):
    """Prepared rows as a stream through a fitted model, against its nodes in batch."""
    train, test, stats = _split(spark, d)
    model = models.fit(train, _small_forest(), stats)
    source, output, checkpoint = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    rows = test.select("series_id", "ts", *MODEL_FEATURES)
    rows.write.parquet(source)
    stream = stream_rows(spark, source, spark.read.parquet(source).schema, 4)
    start_scoring(stream, lambda batch: models.predict(model, batch).select("series_id", "ts", "score"), output, checkpoint).awaitTermination()
    return _compared(spark.read.parquet(output), _replayed(spark, model, rows))


@query("r01_stream_model_scoring")
def _(spark, d):
    """Prepared rows as a stream through a fitted model."""
    train, test, stats = _split(spark, d)
    model = models.fit(train, _small_forest(), stats)
    source, output, checkpoint = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    test.select("series_id", "ts", *MODEL_FEATURES).write.parquet(source)
    schema = spark.read.parquet(source).schema
    rows = stream_rows(spark, source, schema, 4)

    def score(batch: DataFrame) -> DataFrame:
        return scoring.score_rows(batch, model).select("series_id", "ts", *scoring.SIGNAL_COLUMNS)

    start_scoring(rows, score, output, checkpoint).awaitTermination()
    return spark.read.parquet(output)
