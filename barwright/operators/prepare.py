"""Cleaning, checks, split and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.operators.indicators import add_indicators
from barwright.operators.layout import Layout, numbered_by_ranges, numbered_once, with_row_index
from barwright.schema import INDICATORS, MODEL_FEATURES
from barwright.session import materialize

# Columns a raw bar table must have.
REQUIRED = ("ts", "open", "high", "low", "close", "volume")


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def repair_ohlc(bars: DataFrame, margin: float = 100.0) -> DataFrame:
    """Widen high and low so that they bracket open and close."""
    return bars.withColumns(
        {
            "high": F.greatest("open", "high", "close") + margin,
            "low": F.least("open", "close", "low") - margin,
        }
    )


def ohlc_rules() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "high_ge_open": h >= o,
        "high_ge_close": h >= c,
        "high_ge_low": h >= lo,
        "low_le_open": lo <= o,
        "low_le_close": lo <= c,
    }


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Rows checked and rows that break each rule; one pass over the table."""
    rules = ohlc_rules()
    wide = bars.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~cond).alias(name) for name, cond in rules.items()],
    )
    return wide.unpivot("n_rows", list(rules), "rule", "n_violations").select("rule", "n_rows", "n_violations")


def required_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """For each required column: is it there, and how many rows have a value."""
    present = {c.lower(): c for c in df.columns}
    wide = df.agg(
        *[
            (F.count(present[c]) if c in present else F.lit(0).cast("bigint")).alias(c)
            for c in required
        ]
    )
    out = wide.unpivot([], list(required), "column_name", "n_values")
    return out.withColumn("is_present", F.col("column_name").isin(*present))


def split_by_width(df: DataFrame, n_features: int, column: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows whose feature array has the expected length, and the rejected ones."""
    ok = F.coalesce(F.size(column) == n_features, F.lit(False))
    return df.where(ok), df.where(~ok)


def prepare(
    bars: DataFrame,
    layout: Layout = Layout(),
    names: list[str] = INDICATORS,
) -> DataFrame:
    """Bars to labelled, complete feature rows.

    The label is taken before rows are dropped, so it looks at the next bar
    even if that bar is itself dropped.
    """
    return drop_null_rows(add_indicators(bars, names, layout, label=True))


def prepare_split(bars: DataFrame, test_size: float = 0.2, layout: Layout = Layout(), names: list[str] = INDICATORS) -> DataFrame:
    """``time_split`` of ``prepare``, with the feature rows written once and numbered as they are written."""
    rows = drop_null_rows(add_indicators(bars, names, layout, label=True, keep_bucket=True))
    return _with_split(numbered_once(rows, layout), test_size)


def _with_split(indexed: DataFrame, test_size: float) -> DataFrame:
    n_test = F.ceil(F.lit(test_size) * F.col("n_rows"))
    is_test = F.col("row_id") >= F.col("n_rows") - n_test
    return indexed.withColumn("split", F.when(is_test, "test").otherwise("train"))


def time_split(prepared: DataFrame, test_size: float = 0.2, layout: Layout = Layout()) -> DataFrame:
    """First rows of each series are ``train``, the last ceil(test_size * n) ``test``.

    Positions need the rows twice (to count, then to number), so they are stored first unless the layout says
    that they are. From bars, ``prepare_split`` writes them once.
    """
    return _with_split(with_row_index(prepared, layout, index="row_id", total="n_rows"), test_size)


def fit_scaler(df: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where a column is constant."""
    aggs = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features]
    return (
        df.agg(*aggs)
        .unpivot([], features, "feature", "stat")
        .select(
            "feature",
            F.col("stat.m").alias("mean"),
            F.when(F.col("stat.s") == 0, 1.0).otherwise(F.col("stat.s")).alias("std"),
        )
    )


def stats_lookup(stats: DataFrame, features: list[str]) -> Column:
    """The per-feature table as one struct value: a scalar subquery.

    It has one field for each feature, so its size does not depend on the rows.
    """

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("feature") == name, F.col(value))).alias(value)

    fields = [F.struct(of(c, "mean"), of(c, "std")).alias(c) for c in features]
    return stats.agg(F.struct(*fields).alias("s")).scalar()


def apply_scaler(df: DataFrame, stats: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """(x - mean) / std for every feature, with the stored statistics."""
    held = df.withColumn("__stats", stats_lookup(stats, features))

    def scaled(name: str) -> Column:
        s = F.col("__stats")[name]
        return F.try_divide(F.col(name) - s["mean"], s["std"])

    return held.withColumns({c: scaled(c) for c in features}).drop("__stats")


def scale_features(
    split: DataFrame, features: list[str] = MODEL_FEATURES, fit_on: str = "train"
) -> DataFrame:
    """Scale with statistics of the training rows, or of ``all`` rows (which leaks)."""
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    basis = split.where(F.col("split") == "train") if fit_on == "train" else split
    return apply_scaler(split, fit_scaler(basis, features), features)


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.select(
        label, "n", F.try_divide(total["n"].cast("double"), total["k"] * F.col("n")).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str = "target", out: str = "weight") -> DataFrame:
    """The balanced weight on each row; two classes, so it is a constant pair."""
    w = df.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        ).alias("t")
    ).scalar()
    own = F.when(F.col(label) == 1, w["pos"]).otherwise(w["neg"])
    return df.withColumn(out, F.try_divide(w["n"], own * 2))


def with_class_weight_by(df: DataFrame, by: list[str], label: str = "target", out: str = "weight") -> DataFrame:
    """The balanced weight inside each group of ``by``; the counts joined back are two rows a group."""
    if not by:
        return with_class_weight(df, label, out)
    pair = df.groupBy(*by, label).agg(F.count(F.lit(1)).cast("double").alias("__own"))
    whole = pair.groupBy(*by).agg(F.sum("__own").alias("__all"))
    weights = pair.join(whole, by).withColumn(out, F.try_divide(F.col("__all"), F.col("__own") * 2)).drop("__own", "__all")
    return df.join(weights, [*by, label])


def sample_rows(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """A repeatable sample: a row is in or out by the hash of its own key.

    The place in [0, 10000) has a whole part and 32 more bits, so shares below one in ten thousand work too.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    bits = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    place = (bits(1) % 10000).cast("double") + bits(9).cast("double") / float(2**32)
    return df.where(place < F.lit(round(fraction * 10000, 9)))


def stratified_folds(df: DataFrame, n_folds: int, label: str = "target", layout: Layout = Layout(), out: str = "fold") -> DataFrame:
    """Unshuffled stratified folds: within a class, contiguous blocks in time order.

    Class c takes, for fold i, as many rows as the positions of its block in the
    label-sorted table that are congruent to i, which spreads the remainders.
    """
    df = materialize(df, "folds")
    indexed = numbered_by_ranges(df, [label], [layout.ts, *layout.keys, *layout.ties], "__pos", "__n_class")
    n_neg = df.agg(F.count_if(F.col(label) == 0).alias("z")).scalar()
    offset = F.when(F.col(label) == 0, F.lit(0)).otherwise(n_neg)

    def upto(i: int) -> Column:
        # Positions p in [offset, offset + n) with p mod n_folds <= i.
        def below(x: Column) -> Column:
            full = F.floor(x / F.lit(n_folds))
            return full * (i + 1) + F.least(x - full * n_folds, F.lit(i + 1))

        return below(offset + F.col("__n_class")) - below(offset)

    fold = F.lit(0)
    for i in range(n_folds - 1):
        fold = fold + (F.col("__pos") >= upto(i)).cast("int")
    return indexed.withColumn(out, fold).drop("__pos", "__n_class")
