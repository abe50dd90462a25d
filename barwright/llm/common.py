"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for Spark's regular expressions: a run without space, \t, \n, \x0B, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once, for clusters where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_barwright_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="barwright-package-")
    archive = shutil.make_archive(f"{folder}/barwright-package", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._barwright_sent = True


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` cuts at exactly the six characters that WORD leaves out."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case (``bytes.lower`` leaves all other letters alone)."""
    return text.encode().lower().split() if text else []


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def running_total(df: DataFrame, group: str, key: str, ties: list[str], value: str, out: str, bucket_rows: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same group, in order of (key, ties).

    ``key`` is a long spread evenly over its range (a hash). The range is cut into buckets of about
    ``bucket_rows`` rows; sums of earlier buckets are added to a window inside each bucket, so no task
    sees a whole group. ``group`` must not be null.
    """
    bits = max(1, math.ceil(math.log2(max(df.count(), 2) / bucket_rows + 1)))
    flipped = F.col(key).bitwiseXOR(F.lit(-(2**63)))
    cut = df.withColumn("_bucket", F.shiftrightunsigned(flipped, 64 - bits))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(sums, [group, "_bucket"])
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(out, total).drop("_bucket", "_before")


def n_words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, r"[\x20\x09-\x0D]+", -1))).cast("long")
