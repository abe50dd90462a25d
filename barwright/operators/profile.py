"""Exploratory profiling: one wide aggregate per table, reshaped to one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.rules import as_value
from barwright.operators.ordered import approximate_quantiles, exact_quantiles


def class_distribution(df: DataFrame, label: str = "target") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str = "target") -> DataFrame:
    """Class shares in percent and the imbalance flag (class 0 more than 10 points off half)."""
    positive = F.avg(F.col(label).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        positive.alias("positive_ratio"),
        (F.lit(100.0) - positive * 100).alias("pct_down"),
        (positive * 100).alias("pct_up"),
        (F.abs(F.lit(50.0) - positive * 100) > 10).alias("is_imbalanced"),
    )


def moments(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, max) from a single aggregate over the wide rows."""

    def one(c: str) -> Column:
        x = as_value(c)
        return F.struct(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ).alias(c)

    return df.agg(*[one(c) for c in features]).unpivot([], features, "feature", "m").select("feature", "m.*")


def describe(df: DataFrame, features: list[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of each feature."""
    quantiles = exact_quantiles if exact else approximate_quantiles
    return quantiles(df, features, (0.25, 0.5, 0.75), accuracy).select(
        "feature",
        "n",
        "mean",
        "std",
        "min",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        "max",
    )


def null_counts(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Missing values of each column, and their total in a last row ``(all)``."""
    features = features or df.columns
    missing = {c: F.count_if(F.col(c).isNull()) for c in features}
    wide = df.agg(*[m.alias(c) for c, m in missing.items()])
    total = sum((F.col(c) for c in features[1:]), F.col(features[0]))
    return wide.withColumn("(all)", total).unpivot([], [*features, "(all)"], "feature", "n_missing")


def target_correlation(df: DataFrame, features: list[str], label: str = "target") -> DataFrame:
    """|Pearson correlation| of each feature with the label; NULL for a constant column."""
    y = F.col(label).cast("double")

    def one(c: str) -> Column:
        x = as_value(c)
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        spread = F.stddev_samp(xs) * F.stddev_samp(ys)
        return F.abs(F.try_divide(F.covar_samp(xs, ys), spread)).alias(c)

    return df.agg(*[one(c) for c in features]).unpivot([], features, "feature", "abs_corr")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
