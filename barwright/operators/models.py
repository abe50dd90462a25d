"""Classifiers on Spark ML: fit, search, blend, importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.rules import soft_vote, weighted_blend
from barwright.operators.metrics import evaluate, f1_weights, leaderboard
from barwright.operators.prepare import with_class_weight, with_class_weight_by
from barwright.schema import MODEL_FEATURES
from barwright.session import materialize

SEED = 42


def random_forest(
    trees: int = 300, depth: int = 8, weighted: bool = True, min_leaf: int = 1, row_share: float = 1.0, memory_mb: int = 256, node_ids: bool = True
) -> RandomForestClassifier:
    """``min_leaf`` rows at least in a leaf, ``row_share`` of the rows for each tree; nodes of up to ``memory_mb`` are split in one pass.

    With ``node_ids`` the node that each row is in is kept for every tree (4 bytes a row and tree; in memory, else on
    local disk), so that a pass does not walk all trees from their roots. The fitted trees are the same.
    """
    rf = RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, subsamplingRate=row_share, maxMemoryInMB=memory_mb, cacheNodeIds=node_ids, seed=SEED)
    return rf.setWeightCol("weight") if weighted else rf


def boosted_trees(iterations: int = 200, depth: int = 7, step: float = 0.05, min_leaf: int = 1, row_share: float = 1.0, memory_mb: int = 256) -> GBTClassifier:
    return GBTClassifier(
        labelCol="target", maxIter=iterations, maxDepth=depth, stepSize=step, minInstancesPerNode=min_leaf, subsamplingRate=row_share, maxMemoryInMB=memory_mb, seed=SEED
    )


# The settings that are searched. An unlimited depth is Spark's largest, 30.
FOREST_SPACE = {"numTrees": [100, 200, 300], "maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [2, 4]}
BOOSTED_SPACE = {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 0.9, 1.0]}


def settings(estimator, space: dict[str, list]) -> list[dict]:
    """Every combination of a space as parameter maps of the estimator."""
    grid = ParamGridBuilder()
    for name, values in space.items():
        grid = grid.addGrid(estimator.getParam(name), values)
    return grid.build()


def scaling_stage(stats: DataFrame, features: list[str]) -> SQLTransformer:
    """The scaler as a saved stage: its statistics, a pair for each feature, become constants."""
    rows = {r["feature"]: r for r in stats.collect()}
    empty = [c for c in features if rows[c]["mean"] is None]
    if empty:
        raise ValueError(f"no training row has a value of {empty}")
    terms = [f"(`{c}` - {rows[c]['mean']!r}D) / {rows[c]['std']!r}D AS `scaled_{c}`" for c in features]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def feature_stages(stats: DataFrame, features: list[str]) -> list:
    return [
        scaling_stage(stats, features),
        VectorAssembler(inputCols=[f"scaled_{c}" for c in features], outputCol="features"),
    ]


def fit(
    train: DataFrame, estimator, stats: DataFrame, features: list[str] = MODEL_FEATURES
) -> PipelineModel:
    """Scaler, assembler and classifier as one model that scores raw feature rows."""
    if estimator.hasParam("weightCol") and estimator.isDefined("weightCol"):
        train = with_class_weight(train, out=estimator.getOrDefault("weightCol"))
    return Pipeline(stages=[*feature_stages(stats, features), estimator]).fit(train)


def predict(model: PipelineModel, df: DataFrame, name: str = "model") -> DataFrame:
    """Rows plus ``model``, ``score`` = P(up) and ``pred``; helper columns are dropped."""
    scored = model.transform(df)
    keep = [F.col(c) for c in df.columns]
    return scored.select(
        *keep,
        F.lit(name).alias("model"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("pred"),
    )


def f1_evaluator() -> MulticlassClassificationEvaluator:
    """F1 of class 1; the plain ``f1`` of Spark ML is the weighted one."""
    return MulticlassClassificationEvaluator(
        labelCol="target", predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0
    )


def assembled_folds(train: DataFrame, stats: DataFrame, features: list[str] = MODEL_FEATURES, fold_column: str | None = None, weighted: bool = True) -> DataFrame:
    """The rows as a search reads them: target, features, weight and fold, stored once for all settings and folds.

    Class weights must not look at held-out rows. One column cannot hold a weight for each fold that is left out, so
    with ``fold_column`` the classes are balanced inside each fold; then they are in the rest of the folds too.
    """
    if weighted:
        train = with_class_weight_by(train, [fold_column] if fold_column else [], out="weight")
    assembled = Pipeline(stages=feature_stages(stats, features)).fit(train).transform(train)
    keep = ["target", "features"] + [c for c in ("weight", fold_column) if c and c in assembled.columns]
    return materialize(assembled.select(*keep), "assembled")


def grid_search(
    train: DataFrame,
    estimator,
    grid: list[dict],
    stats: DataFrame,
    features: list[str] = MODEL_FEATURES,
    folds: int = 5,
    fold_column: str | None = None,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validated F1 over a grid; ``fold_column`` gives the folds (see stratified_folds)."""
    weighted = estimator.hasParam("weightCol") and estimator.isDefined("weightCol")
    return _cross_validated(assembled_folds(train, stats, features, fold_column, weighted), estimator, grid, folds, fold_column, parallelism)


def _cross_validated(rows: DataFrame, estimator, grid: list[dict], folds: int, fold_column: str | None, parallelism: int) -> CrossValidatorModel:
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=f1_evaluator(), numFolds=folds, seed=SEED, parallelism=parallelism, collectSubModels=False)
    return (cv.setFoldCol(fold_column) if fold_column else cv).fit(rows)


def search(
    train: DataFrame,
    spaces: dict,
    stats: DataFrame,
    features: list[str] = MODEL_FEATURES,
    folds: int = 5,
    fold_column: str | None = None,
    parallelism: int = 4,
) -> tuple[DataFrame, dict[str, CrossValidatorModel]]:
    """Several estimators, each over its own settings: ``spaces`` is name -> (estimator, parameter maps).

    All read one stored table of assembled, weighted rows with their folds. The first result has a row
    (estimator, params, mean_f1, is_best) for every setting of all, the second the fitted searches.
    """
    rows = assembled_folds(train, stats, features, fold_column)
    results = {name: _cross_validated(rows, estimator, grid, folds, fold_column, parallelism) for name, (estimator, grid) in spaces.items()}
    tables = [search_table(train.sparkSession, r).withColumn("estimator", F.lit(name)) for name, r in results.items()]
    every = reduce(DataFrame.unionByName, tables)
    top = max(max(r.avgMetrics) for r in results.values())
    first = next(name for name, r in results.items() if max(r.avgMetrics) == top)
    best = F.col("is_best") & (F.col("estimator") == first)
    return every.select("estimator", "params", "mean_f1", best.alias("is_best")), results


def search_table(spark: SparkSession, result: CrossValidatorModel) -> DataFrame:
    """(params, mean_f1, is_best) for the tried settings."""
    best = max(range(len(result.avgMetrics)), key=lambda i: result.avgMetrics[i])
    rows = [
        (
            {p.name: str(v) for p, v in params.items()} or {"": "defaults"},
            float(score),
            i == best,
        )
        for i, (params, score) in enumerate(zip(result.getEstimatorParamMaps(), result.avgMetrics))
    ]
    return spark.createDataFrame(rows, "params map<string,string>, mean_f1 double, is_best boolean")


def wide_scores(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Every model's P(up) as a column ``p_<name>`` on the same rows, without a join."""

    def one(rows: DataFrame, item) -> DataFrame:
        name, model = item
        keep = [F.col(c) for c in rows.columns]
        return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias(f"p_{name}"))

    return reduce(one, models.items(), df)


def ensemble(wide: DataFrame, names: list[str], name: str = "soft_vote") -> DataFrame:
    """Plain mean of the models' probabilities."""
    p = soft_vote(*[F.col(f"p_{n}") for n in names])
    return wide.withColumn("model", F.lit(name)).withColumn("score", p).withColumn("pred", (p > 0.5).cast("int"))


def blend(wide: DataFrame, weights: DataFrame, names: list[str], name: str = "f1_blend") -> DataFrame:
    """Mean of the probabilities weighted by F1 share; ``weights`` has a row per model."""
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("m")).scalar()
    held = wide.withColumn("__w", table)
    p = weighted_blend([(F.col(f"p_{n}"), F.col("__w")[n]) for n in names])
    return (
        held.withColumn("model", F.lit(name))
        .withColumn("score", p)
        .withColumn("pred", (F.col("score") > 0.5).cast("int"))
        .drop("__w")
    )


def validation_metrics(models: dict[str, PipelineModel], validation: DataFrame) -> DataFrame:
    """The metrics of every model on a validation slice; all score it in one scan."""
    wide = wide_scores(models, validation)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("score")) for n in models]))
    long = wide.select(F.col("target").alias("y"), each.alias("s")).select("y", "s.*").withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return evaluate(long)


def best_ensemble(models: dict[str, PipelineModel], validation: DataFrame, rows: DataFrame, k: int = 3, name: str = "soft_vote") -> tuple[DataFrame, list[str]]:
    """(``rows`` scored by the mean of the k best models, their names): the leaderboard on ``validation`` chooses."""
    board = leaderboard(validation_metrics(models, validation)).orderBy("position").limit(k)
    names = [r["model"] for r in board.collect()]  # a row for each model
    return ensemble(wide_scores({n: models[n] for n in names}, rows), names, name), names


def validation_weights(models: dict[str, PipelineModel], validation: DataFrame) -> DataFrame:
    """F1 shares taken from a validation slice, so the test rows stay unseen."""
    return f1_weights(validation_metrics(models, validation))


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """(feature, importance) of a fitted tree model: one row per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def top_importance(spark: SparkSession, model: PipelineModel, n: int, features: list[str] = MODEL_FEATURES) -> DataFrame:
    return feature_importance(spark, model, features).orderBy(F.desc("importance"), "feature").limit(n)


