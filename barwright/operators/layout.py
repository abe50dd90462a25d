"""Splitting long series so that positional windows run in many tasks.

Offsets in this library count rows, not hours, and one series may hold a large share of the table, so a window
over a whole series would end in one task. A series is cut into *buckets* at running row counts, so that sparse
and dense stretches give buckets of one size. Cuts lie between time *slices* of about ``slice_bars`` rows; a table
of one short row for each slice, with its first position in the series, is all that is needed to find them. Each
bucket also receives the few rows before and after it that its windows look at (its halo).

The rows themselves are stored once, counted by two columns, and exchanged once, with the halo rows added.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barwright.functions.clock import slot
from barwright.session import materialize

BUCKET, SLICE, CORE = "__bucket", "__slice", "__core"


@dataclass(frozen=True)
class Layout:
    """How series are cut.

    ``ts`` (then ``ties``) orders the rows of one ``keys`` value. A bucket holds ``bucket_rows`` rows, plus less
    than one slice; a slice holds ``slice_bars`` rows where there is one bar per ``bar_seconds``, and fewer where
    bars are missing. Give ``bar_seconds`` the usual distance of rows where they are denser. ``stored`` says that
    the rows are a table already, which need not be written before it is read twice.
    """

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    ties: tuple[str, ...] = field(default=())
    bar_seconds: int = 3600
    slice_bars: int = 16
    slices_per_bucket: int = 256
    stored: bool = False

    @property
    def slice_seconds(self) -> int:
        return self.bar_seconds * self.slice_bars

    @property
    def bucket_rows(self) -> int:
        return self.slice_bars * self.slices_per_bucket

    def order(self) -> list[str]:
        return [self.ts, *self.ties]

    def slice_of(self) -> Column:
        return slot(F.col(self.ts), self.slice_seconds)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BUCKET).orderBy(*self.order())


def stored_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """``df`` as a table: rows are read twice, to be counted and to be exchanged."""
    return df if layout.stored else materialize(df, "rows")


def slice_table(rows: DataFrame, layout: Layout) -> DataFrame:
    """(keys, slice, bucket, start, end, total): positions of every non-empty slice in its series.

    Counts are chained over spans of a bucket's slices first and inside each span then, so no task chains all
    slices of a series.
    """
    keys = list(layout.keys)
    span = F.floor(F.col(SLICE) / F.lit(layout.slices_per_bucket)).alias("__span")
    per_slice = rows.groupBy(*keys, layout.slice_of().alias(SLICE)).agg(F.count(F.lit(1)).alias("__n")).select("*", span)
    per_slice = materialize(per_slice, "slices")
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = per_slice.groupBy(*keys, "__span").agg(F.sum("__n").alias("__m"))
    spans = spans.select(*keys, "__span", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__first"), F.sum("__m").over(whole).alias("__total"))
    spans, on = _renamed(spans, layout, "__span")
    inside = Window.partitionBy(*keys, "__span").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__first") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    placed = per_slice.join(spans, on).select(*keys, SLICE, "__n", start.alias("__start"), "__total")
    bucket = F.expr(f"__start div {layout.bucket_rows}").alias(BUCKET)
    return materialize(placed.select(*keys, SLICE, bucket, "__start", (F.col("__start") + F.col("__n")).alias("__end"), "__total"), "placed_slices")


def _halo_targets(slices: DataFrame, layout: Layout, back: int, ahead: int) -> DataFrame:
    """(keys, slice, targets): for each slice that other buckets look into, these buckets.

    A bucket asks for positions just before and after its own; slices and requests meet on blocks of positions.
    """
    keys, rows = list(layout.keys), layout.bucket_rows
    ends = slices.groupBy(*keys, BUCKET).agg(F.min("__start").alias("__low"), F.max("__end").alias("__high"), F.first("__total").alias("__total"))
    low, high = F.col("__low"), F.col("__high")
    wanted = []
    if back:
        wanted.append(F.struct(F.greatest(low - back, F.lit(0)).alias("from"), low.alias("to")))
    if ahead:
        wanted.append(F.struct(high.alias("from"), F.least(high + ahead, F.col("__total")).alias("to")))
    asked = ends.select(*keys, F.col(BUCKET).alias("__for"), F.inline(F.array(*wanted))).where("`from` < `to`")
    asked = asked.withColumn("__block", F.explode(F.expr(f"sequence(`from` div {rows}, (`to` - 1) div {rows})")))
    held = slices.withColumn("__block", F.explode(F.expr(f"sequence(__start div {rows}, (__end - 1) div {rows})")))
    asked, on = _renamed(asked, layout, "__block")
    met = held.join(asked, on).where((F.col("__start") < F.col("to")) & (F.col("__end") > F.col("from")) & (F.col("__for") != F.col(BUCKET)))
    return met.groupBy(*keys, SLICE).agg(F.collect_set("__for").alias("__targets"))


def _key_aliases(layout: Layout) -> list[str]:
    return [f"__k{i}" for i in range(len(layout.keys))] + ["__at"]


def _renamed(small: DataFrame, layout: Layout, part: str) -> tuple[DataFrame, Column]:
    """The small per-part table under other key names, and a join condition that
    also matches rows whose key is NULL (they form a series of their own)."""
    names = [*layout.keys, part]
    aliases = _key_aliases(layout)
    on = reduce(and_, [F.col(n).eqNullSafe(F.col(a)) for n, a in zip(names, aliases)])
    return small.withColumnsRenamed(dict(zip(names, aliases))), on


def with_halo(df: DataFrame, layout: Layout, back: int, ahead: int = 0) -> DataFrame:
    """Rows assigned to their bucket and copied into the buckets that look at them.

    Adds ``__bucket`` and ``__core`` (false for halo copies).  Every core row
    then has at least ``back`` earlier and ``ahead`` later rows of its series in
    its bucket, or all that exist. Copies are whole slices: fewer than ``back`` + ``ahead`` + 2 slices' rows a bucket.
    """
    rows = stored_rows(df, layout)
    slices = slice_table(rows, layout)
    none = F.array().cast("array<bigint>")
    places = slices.select(*layout.keys, SLICE, F.array(BUCKET).alias("__buckets"))
    if back or ahead:
        targets, on = _renamed(_halo_targets(slices, layout, back, ahead), layout, SLICE)
        joined = slices.join(targets, on, "left")
        places = joined.select(*layout.keys, SLICE, F.concat(F.array(BUCKET), F.coalesce("__targets", none)).alias("__buckets"))
    places, on = _renamed(materialize(places, "places"), layout, SLICE)
    dealt = rows.withColumn(SLICE, layout.slice_of()).join(places, on)
    return (
        dealt.select(*df.columns, F.col("__buckets")[0].alias("__own"), F.explode("__buckets").alias(BUCKET))
        .withColumn(CORE, F.col(BUCKET) == F.col("__own"))
        .drop("__own")
    )


def core_rows(df: DataFrame, keep_bucket: bool = False) -> DataFrame:
    core = df.where(CORE).drop(CORE)
    return core if keep_bucket else core.drop(BUCKET)


def with_row_index(df: DataFrame, layout: Layout, index: str = "row_id", total: str | None = None) -> DataFrame:
    """Position (from 0) of each row in its ``keys`` group, and the group size.

    The positions inside a bucket come from a window per bucket; the bucket's
    start comes from the running counts of the slices.
    """
    keys = list(layout.keys)
    rows = stored_rows(df, layout)
    slices = slice_table(rows, layout)
    starts = slices.groupBy(*keys, BUCKET).agg(F.min("__start").alias("__first"))
    starts, on = _renamed(starts, layout, BUCKET)
    places = slices.join(starts, on).select(*keys, SLICE, BUCKET, "__first", "__total")
    places, on = _renamed(materialize(places, "places"), layout, SLICE)
    out = rows.withColumn(SLICE, layout.slice_of()).join(places, on)
    out = out.withColumn(index, F.col("__first") + F.row_number().over(layout.window()) - 1)
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop(BUCKET, SLICE, "__first", "__total", *_key_aliases(layout))


def numbered_once(df: DataFrame, layout: Layout, index: str = "row_id", total: str = "n_rows") -> DataFrame:
    """``df``, which still has its ``__bucket`` (see ``core_rows``), with positions and group sizes.

    Rows are numbered in their buckets as they are written, once; what the buckets start at follows from their
    counts and is added when the table is read.
    """
    keys = list(layout.keys)
    stored = materialize(df.withColumn("__local", F.row_number().over(layout.window()) - 1), "numbered")
    counts = stored.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(whole).alias("__total"))
    starts, on = _renamed(materialize(starts, "starts"), layout, BUCKET)
    kept = [c for c in stored.columns if c not in (BUCKET, "__local")]
    return stored.join(starts, on).select(*kept, (F.col("__first") + F.col("__local")).alias(index), F.col("__total").alias(total))


def numbered_by_ranges(df: DataFrame, group: list[str], order: list[str], index: str, total: str) -> DataFrame:
    """``df`` with positions (from 0) in each group by ``order``, and group sizes, however rows pile up on one key.

    Rows are sorted in ranges of (group, order, a number that splits equal rows) and numbered as they are written;
    the counts of the ranges are chained. ``group`` must not be null.
    """
    keys = [*group, *order, "__tie"]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    stored = materialize(ranged.drop("__tie"), "ranges")
    counts = stored.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "__part", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(whole).alias(total))
    placed = stored.join(starts, [*group, "__part"])
    return placed.withColumn(index, F.col("__first") + F.col("__at") - F.col("__low")).select(*df.columns, index, total)
