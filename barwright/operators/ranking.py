"""Sorting, top-k and time-ordered slices of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.layout import Layout, with_row_index


def sort_by_time(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """A total order: time, then the keys and tie breakers."""
    return df.orderBy(layout.ts, *layout.keys, *layout.ties)


def top_by(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The n largest; Spark keeps n rows per task, not a sorted table."""
    return df.orderBy(F.desc_nulls_last(column), tie).limit(n)


def first_rows(df: DataFrame, n: int, layout: Layout = Layout()) -> DataFrame:
    return df.orderBy(layout.ts, *layout.keys, *layout.ties).limit(n)


def last_rows(df: DataFrame, n: int, layout: Layout = Layout()) -> DataFrame:
    latest = [F.desc(c) for c in (layout.ts, *layout.keys, *layout.ties)]
    return df.orderBy(*latest).limit(n)


def last_rows_per_series(df: DataFrame, n: int, layout: Layout = Layout()) -> DataFrame:
    """The last n rows of every series, from positions that no single task has to number."""
    indexed = with_row_index(df, layout, index="__pos", total="__size")
    return indexed.where(F.col("__pos") >= F.col("__size") - n).drop("__pos", "__size")


def append_batches(*batches: DataFrame) -> DataFrame:
    """Batches one after the other with a ``batch`` number (from 0)."""
    tagged = [b.withColumn("batch", F.lit(i)) for i, b in enumerate(batches)]
    out = tagged[0]
    for b in tagged[1:]:
        out = out.unionByName(b)
    return out
