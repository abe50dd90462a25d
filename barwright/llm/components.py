"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.session import materialize


def _masks():
    """An endless row of signed 64-bit numbers that look random and are the same in every run."""
    x = 0x9E3779B97F4A7C15
    while True:
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        mixed = x ^ (x >> 29)
        yield mixed - 2**64 if mixed >= 2**63 else mixed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs); component is the least node reachable.

    Each round every node points to the least of itself and its neighbours, in an order that a fresh mask
    shuffles, then to where that one points; edges move along and those inside one target vanish. Random
    order keeps pointer trees low, whatever the ids, so the graph shrinks by a steady factor and the work is
    in proportion to the edges. Rounds are written to the shared folder: a lost executor costs one round, and
    both sides of each join are plain scans, which the engine can split where a target is hot.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    masks = _masks()
    while not steps or left.take(1):
        mask = F.lit(next(masks))
        both = left.union(left.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        parent = materialize(least.select("node", F.least("m", F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask).alias("target")), "parents")
        step = parent.join(parent.select(F.col("node").alias("target"), F.col("target").alias("next")), "target")
        step = materialize(step.select("node", F.col("next").alias("target")), "targets")
        for side in ("a", "b"):
            left = left.join(step.withColumnsRenamed({"node": side, "target": "to"}), side).drop(side).withColumnRenamed("to", side)
        left = materialize(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        steps.append(step)
    total = steps.pop()
    while steps:
        later = total.select(F.col("node").alias("target"), F.col("target").alias("last"))
        total = steps.pop().join(later, "target", "left").select("node", F.coalesce("last", "target").alias("target"))
        total = materialize(total, "targets")
    names = materialize(total.groupBy("target").agg(F.min("node").alias("component")), "names")
    return total.join(names, "target").select("node", "component")
