"""Fitted trees as tables of nodes, and scoring by descent through them.

A node is a row (tree, node, feature, threshold, left, right, value, n, weight): inner nodes send a row left where
the feature is at most the threshold; the value of the leaf that a row ends in, summed over trees by weight, is the
ensemble's score. A table of nodes can be stored, queried and joined like any other, cut to fewer trees, smaller
depth or larger nodes, and gives the fitted model's probabilities in plain expressions, in batch and on streams.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barwright.schema import MODEL_FEATURES
from barwright.session import scratch_path

NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left", "right", "value", "n", "weight"]


def node_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The nodes of the model's last stage, a random forest or boosted trees for two classes.

    A forest's value is the share of class 1 and its weights are 1 / trees; boosted trees give half the log odds.
    """
    trees = model.stages[-1]
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    raw = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("w"))
    stats, boosted = F.col("impurityStats"), "GBT" in type(trees).__name__
    value = F.col("prediction") if boosted else F.try_divide(stats[1], stats[0] + stats[1])
    inner = F.col("leftChild") >= 0
    nodes = raw.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        value.alias("value"),
        F.col("rawCount").alias("n"),
    )
    weight = F.col("w") if boosted else F.lit(1.0 / trees.getNumTrees)
    return nodes.join(weights, nodes["tree"] == weights["treeID"]).select(*NODE_COLUMNS[:-1], weight.alias("weight"))


def cut_trees(nodes: DataFrame, trees: int | None = None, depth: int | None = None, min_split: int | None = None) -> DataFrame:
    """The same ensemble with fewer trees, smaller depth, or no split of nodes with fewer rows than ``min_split``.

    Trees grow from the top, one after the other, so what is left is what growing with these limits gives for a
    given choice of features. Nodes below a cut stay in the table, out of reach. Shares are taken of what is left.
    """
    out = nodes
    if trees is not None:
        kept = out.where(F.col("tree") < trees)
        total = out.agg(F.max("tree").alias("t")).scalar() + 1
        out = kept.withColumn("weight", F.when(F.lit(_equal_weights(nodes)), F.col("weight") * total / F.lit(trees)).otherwise(F.col("weight")))
    stop = F.lit(False)
    if depth is not None:
        out = _with_depth(out)
        stop = stop | (F.col("depth") >= depth)
    if min_split is not None:
        stop = stop | (F.col("n") < min_split)
    links = [F.when(~stop, F.col(c)).alias(c) for c in ("feature", "threshold", "left", "right")]
    return out.select("tree", "node", *links, "value", "n", "weight")


def _equal_weights(nodes: DataFrame) -> bool:
    low, high = nodes.agg(F.min("weight"), F.max("weight")).first()
    return low is not None and low == high and low < 1.0


def _with_depth(nodes: DataFrame) -> DataFrame:
    """Depth of every node. Node numbers run through a tree from the top, left before right, so it is a count of open ancestors."""
    w = Window.partitionBy("tree")
    ends = nodes.withColumn("all", F.collect_list(F.struct("node", "left", "right")).over(w))
    above = F.filter("all", lambda a: a["left"].isNotNull() & (a["node"] < F.col("node")) & (F.col("node") <= _last(F.col("all"), a)))
    return ends.withColumn("depth", F.size(above)).drop("all")


def _last(every: Column, node: Column) -> Column:
    """The last node below ``node``: the right child's right child and so on."""
    links = F.map_from_entries(F.transform(F.filter(every, lambda a: a["right"].isNotNull()), lambda a: F.struct(a["node"], a["right"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), node["node"], lambda at, _: F.coalesce(F.try_element_at(links, at), at))


def packed(nodes: DataFrame) -> Column:
    """All trees as one value, a scalar subquery: it is as large as the model, whatever the rows."""
    columns = ["node", "feature", "threshold", "left", "right", "value"]
    trees = nodes.groupBy("tree").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list(F.struct(*columns))).alias("nodes"))
    return trees.agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees")).scalar()


def descend(trees: Column, x: Column, depth: int = 32) -> Column:
    """The weighted sum of leaf values for the features in the array ``x``; nodes are numbered 0, 1, ... in each tree."""

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            goes_left = F.get(x, at["feature"]) <= at["threshold"]
            return F.when(at["left"].isNull(), at).otherwise(F.get(tree["nodes"], F.when(goes_left, at["left"]).otherwise(at["right"])))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.get(tree["nodes"], F.lit(0)), step)["value"]

    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + tree["weight"] * leaf(tree))


def score_by_nodes(rows: DataFrame, nodes: DataFrame, features: list[str] = MODEL_FEATURES, boosted: bool = False, depth: int = 32, name: str = "trees") -> DataFrame:
    """``rows`` plus model, score = P(up) and pred, as ``predict`` gives them; ``features`` in the order of the fit."""
    held = rows.withColumn("__trees", packed(nodes))
    total = descend(F.col("__trees"), F.array(*[F.col(c).cast("double") for c in features]), depth)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(total * -2.0)) if boosted else total
    return held.withColumn("model", F.lit(name)).withColumn("score", p).withColumn("pred", (F.col("score") > 0.5).cast("int")).drop("__trees")


def mean_split_trees(train: DataFrame, features: list[str], label: str = "target") -> DataFrame:
    """A small forest by plain aggregates: a tree for each pair of neighbouring features, split at their means.

    Each tree asks for the first feature, then on both sides for the second; a leaf's value is its share of class
    1, that of the whole table where no row ends in it. Two passes fit it whatever the number of trees.
    """
    means = train.agg(*[F.avg(c).alias(c) for c in features])
    held = train.withColumn("__m", means.agg(F.struct(*[F.first(c).alias(c) for c in features]).alias("m")).scalar())
    above = {c: (F.col(c) > F.col("__m")[c]).cast("int") for c in features}
    pairs = list(zip(features, features[1:]))
    leaves = F.explode(F.array(*[F.struct(F.lit(i).alias("tree"), (above[a] * 2 + above[b]).alias("leaf")) for i, (a, b) in enumerate(pairs)]))
    counts = held.select(F.col(label).alias("y"), leaves.alias("l")).groupBy("l.tree", "l.leaf").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("value"))
    total = train.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("value"))
    spark = train.sparkSession
    grid = spark.createDataFrame([(i, k, k) for i in range(len(pairs)) for k in range(4)], "tree int, leaf int, l int").drop("l")
    share = total.select("value").scalar()
    ends = grid.join(counts, ["tree", "leaf"], "left").select("tree", F.expr("CASE leaf WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 6 END").alias("node"), F.coalesce("value", share).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    none = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right")]
    ends = ends.select("tree", "node", *none, "value", "n")
    marks = means.unpivot([], features, "name", "threshold")
    shape = [(i, at, f, features[f], left, right) for i in range(len(pairs)) for at, f, left, right in ((0, i, 1, 4), (1, i + 1, 2, 3), (4, i + 1, 5, 6))]
    inner = spark.createDataFrame(shape, "tree int, node int, feature int, name string, left int, right int").join(marks, "name")
    inner = inner.select("tree", "node", "feature", "threshold", "left", "right", F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("n"))
    return inner.union(ends).withColumn("weight", F.lit(1.0 / len(pairs)))
