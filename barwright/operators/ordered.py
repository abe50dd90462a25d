"""Range parts for prefix aggregates, and exact quantiles without one-task groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.rules import as_value
from barwright.session import materialize

RANGE = "__range"


def range_parts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows range-partitioned by (keys, value), with the partition number.

    Partitions are of equal size whatever the share of a key, and their numbers
    follow the order of the values.  Callers reduce each (keys, part) to a row
    in the same pass and then chain the few rows; no second branch reads the
    partition number, so the sampled bounds need not repeat.
    """
    return df.repartitionByRange(*keys, value).withColumn(RANGE, F.spark_partition_id())


def exact_quantiles(
    df: DataFrame,
    features: list[str],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    accuracy: int = 10000,
    most: int = 10_000,
) -> DataFrame:
    """(feature, n, mean, std, min, max, q0, q1, ...): moments and exact, linearly
    interpolated quantiles.

    No column is sorted, ranked or buffered. One pass takes the moments and approximate marks around every wanted
    rank. A counting pass tells what lies below the marks and between them; a bracket that misses its rank is
    widened again. Brackets that still hold more than ``most`` values get marks of their own, inside them, and are
    counted again: each turn leaves a fixed small share, so a few turns do for any size, and copies of one value
    never count as many. The values left, at most ``most`` and the two marks, are one short array per rank.
    ``df`` is read twice, and twice more a turn, so pass a stored table.
    """
    k, most = len(probabilities), max(most, 16)  # so few cannot be cut any further
    margin = 4.0 / accuracy

    def summary(c: str) -> Column:
        x = as_value(c)
        return F.struct(
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.percentile_approx(x, [*[max(0.0, p - margin) for p in probabilities], *[min(1.0, p + margin) for p in probabilities]], accuracy).alias("marks"),
        ).alias(c)

    every = df.agg(*[summary(c) for c in features]).unpivot([], features, "feature", "b").select("feature", "b.*")
    every = materialize(every, "summaries")
    long = df.select([as_value(c).alias(c) for c in features]).unpivot([], features, "feature", "value").where("value is not null")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p"), F.col("marks")[i].alias("low"), F.col("marks")[k + i].alias("high")) for i, p in enumerate(probabilities)]))
    open_ = every.where("n > 0").select("feature", "n", F.col("min").alias("from"), F.col("max").alias("to"), each.alias("t"))
    open_ = open_.select("feature", "n", "from", "to", "t.*").withColumn("rank", F.col("p") * (F.col("n") - 1))
    done = []
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    while True:
        tally = long.join(open_, "feature").groupBy("feature", "q").agg(
            F.count_if(value < low).alias("below"), F.count_if(value <= high).alias("upto"), F.count_if((value > low) & (value < high)).alias("inside"),
            F.count_if(value < F.col("from")).alias("outside"), F.count_if((value > F.col("from")) & (value < F.col("to"))).alias("all"),
        )
        counted = materialize(open_.join(tally, ["feature", "q"]), "brackets")
        met = (F.col("below") <= F.floor("rank")) & (F.col("upto") > F.ceil("rank"))
        counted = counted.select(
            "feature", "q", "p", "n", "rank", F.when(met, low).otherwise(F.col("from")).alias("from"), F.when(met, high).otherwise(F.col("to")).alias("to"),
            F.when(met, F.col("below")).otherwise(F.col("outside")).alias("below"), F.when(met, F.col("inside")).otherwise(F.col("all")).alias("left"),
        )
        done.append(counted.where(F.col("left") <= most).select("feature", "q", "rank", "from", "to", "below"))
        large = materialize(counted.where(F.col("left") > most), "large_brackets")
        if not large.take(1):
            break
        # The bracket's inner values with the marks around them; ranks count from the inner values' own first one.
        inner = long.join(large, "feature").where((value > F.col("from")) & (value < F.col("to")))
        size = F.count(F.lit(1))
        marks = inner.groupBy("feature", "q").agg(size.alias("m"), F.percentile_approx("value", F.array(*[F.lit(i / 1000.0) for i in range(1001)]), 10_000).alias("marks"))
        at_from = long.join(large, "feature").groupBy("feature", "q").agg(F.count_if(value == F.col("from")).alias("equal"))
        near = large.join(marks, ["feature", "q"]).join(at_from, ["feature", "q"])
        place = (F.col("rank") - F.col("below") - F.col("equal")) / F.col("m") * 1000.0
        spare = F.lit(1.5) + F.lit(1000.0) / F.col("m")  # the marks' own error, and one value more on each side
        first, last = F.floor(place - spare).cast("int"), F.ceil(place + spare).cast("int")
        mark = lambda i: F.get("marks", F.least(F.greatest(i, F.lit(0)), F.lit(1000)))
        below_all, above_all = F.when(first < 0, F.col("from")), F.when(last > 1000, F.col("to"))
        open_ = materialize(near.select("feature", "q", "p", "n", "rank", "from", "to", F.coalesce(below_all, mark(first)).alias("low"), F.coalesce(above_all, mark(last)).alias("high")), "marks")

    targets = reduce(DataFrame.union, done)
    inside = long.join(targets, "feature").where((value >= F.col("from")) & (value <= F.col("to")))
    counts = inside.groupBy("feature", "q", "rank", "below", "value").agg(F.count(F.lit(1)).alias("n"))
    arrays = counts.groupBy("feature", "q", "rank", "below").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values"))
    none = F.lit(None).cast("double")
    start = F.struct(F.col("below").alias("upto"), none.alias("lower"), none.alias("upper"))

    def step(state: Column, item: Column) -> Column:
        upto = state["upto"] + item["n"]
        lower = F.coalesce(state["lower"], F.when(upto > F.floor("rank"), item["value"]))
        upper = F.coalesce(state["upper"], F.when(upto > F.ceil("rank"), item["value"]))
        return F.struct(upto.alias("upto"), lower.alias("lower"), upper.alias("upper"))

    found = arrays.select("feature", "q", "rank", F.aggregate("values", start, step).alias("s"))
    part = F.col("rank") - F.floor("rank")
    picked = found.select("feature", "q", (F.col("s.lower") + (F.col("s.upper") - F.col("s.lower")) * part).alias("v"))
    wide = picked.groupBy("feature").agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(f"q{i}") for i in range(k)])
    return every.drop("marks").join(wide, "feature", "left")


def approximate_quantiles(
    df: DataFrame,
    features: list[str],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    accuracy: int = 10000,
) -> DataFrame:
    """The same columns in one pass: quantiles are values within 1/accuracy of each rank."""
    def one(c: str) -> Column:
        x = as_value(c)
        return F.struct(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.percentile_approx(x, list(probabilities), accuracy).alias("q"),
        ).alias(c)

    wide = df.agg(*[one(c) for c in features]).unpivot([], features, "feature", "s").select("feature", "s.*")
    return wide.select("*", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probabilities))]).drop("q")
