"""Distribution drift between a reference and a current table.

Tables stay wide for moments (one aggregate each) and are unpivoted to
(feature, value) only where values are ranked or binned.  Everything joined
back to rows is one row per feature (and current group), whatever the data size.

Every method takes ``by``: a column of the current table whose values are
compared with the reference separately, in one pass, without copying the
reference for each of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barwright.functions.pvalues import ks_p_value, ks_p_value_exact, welch_p_value
from barwright.functions.rules import as_value, drift_action, drift_severity, psi_label
from barwright.operators.ordered import RANGE, exact_quantiles, range_parts
from barwright.operators.profile import moments
from barwright.session import materialize

BINS = 10
EMPTY_SHARE = 0.0001
MIN_ROWS = 10
#: Values on either side up to which the KS p-value is exact; its cost is the product of both sides for each result row.
EXACT_KS = 100

# Default thresholds, and the named presets.
DEFAULT_THRESHOLDS = {"ks": 0.05, "psi": 0.1, "ttest": 0.05}
PRESETS = {
    "strict": {"ks": 0.01, "psi": 0.05, "ttest": 0.01},
    "moderate": {"ks": 0.05, "psi": 0.10, "ttest": 0.05},
    "loose": {"ks": 0.10, "psi": 0.25, "ttest": 0.10},
}


def common_numeric_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns that are double or long in both tables."""
    numeric = (T.DoubleType, T.LongType)
    there = {f.name for f in current.schema.fields if isinstance(f.dataType, numeric)}
    return [f.name for f in reference.schema.fields if isinstance(f.dataType, numeric) and f.name in there]


def usable_features(current: DataFrame, features: Iterable[str]) -> tuple[list[str], list[str]]:
    """Features the current table has, and the ones to skip."""
    there = set(current.columns)
    features = list(features)
    return [f for f in features if f in there], [f for f in features if f not in there]


def reference_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, median, q1, q3) without missing values."""
    return exact_quantiles(df, features, (0.5, 0.25, 0.75)).select(
        "feature",
        "mean",
        "std",
        "min",
        "max",
        F.col("q0").alias("median"),
        F.col("q1").alias("q1"),
        F.col("q2").alias("q3"),
    )


def _long(df: DataFrame, features: list[str], by: str | None, group: str = "grp") -> DataFrame:
    """(feature, grp, value) of the non-missing values."""
    ids = [F.col(by).cast("string").alias(group)] if by else [F.lit("current").alias(group)]
    wide = df.select(*ids, *[as_value(c).alias(c) for c in features])
    return wide.unpivot(group, features, "feature", "value").where("value is not null")


def _side_moments(df: DataFrame, features: list[str], by: str | None) -> DataFrame:
    """(grp, feature, n, mean, std, lo, hi): one wide aggregate, one row per group and feature."""

    def one(c: str) -> Column:
        x = as_value(c)
        return F.struct(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.var_samp(x).alias("var"),
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
        ).alias(c)

    key = F.col(by).cast("string") if by else F.lit("current")
    wide = df.groupBy(key.alias("grp")).agg(*[one(c) for c in features])
    return wide.unpivot("grp", features, "feature", "m").select("grp", "feature", "m.*")


def paired_moments(
    reference: DataFrame, current: DataFrame, features: list[str], by: str | None = None
) -> DataFrame:
    """Moments of both sides on one row per (grp, feature); every method starts here.

    The table is tiny and read by several branches, so it is written once to
    the shared folder: the data is scanned once for it, and later joins know
    its true size.
    """
    ref = _side_moments(reference, features, None).drop("grp")
    ref = ref.select("feature", *[F.col(c).alias(f"ref_{c}") for c in ref.columns if c != "feature"])
    cur = _side_moments(current, features, by)
    cur = cur.select("grp", "feature", *[F.col(c).alias(f"cur_{c}") for c in cur.columns if c not in ("grp", "feature")])
    return materialize(cur.join(ref, "feature"), "moments")


# -- Kolmogorov-Smirnov ------------------------------------------------------


def ks_statistic(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    standardize: bool,
    by: str | None = None,
    pair: DataFrame | None = None,
) -> DataFrame:
    """(grp, feature, statistic, n_ref, n_cur): largest gap of the two distribution functions.

    Values are first counted, so copies travel as one row.  Distinct values are
    range-partitioned; each part yields, for every current group, the extremes
    of the gap relative to the part's start.  Chaining the parts' totals then
    gives the exact maximum, so no feature is ever ranked in one task.
    """
    pair = pair if pair is not None else paired_moments(reference, current, features, by)
    ref = _long(reference, features, None).drop("grp").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cur = _long(current, features, by).groupBy("grp", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    if standardize:
        # Scaling keeps the order inside a side, so it is applied to the counted values.
        ref_scale = pair.groupBy("feature").agg(F.first("ref_mean").alias("mean"), F.first("ref_std").alias("std"))
        cur_scale = pair.select("grp", "feature", F.col("cur_mean").alias("mean"), F.col("cur_std").alias("std"))
        ref = ref.join(ref_scale, "feature").select("feature", _scaled(), "n")
        cur = cur.join(cur_scale, ["grp", "feature"]).select("grp", "feature", _scaled(), "n")
    both = ref.select(F.lit(None).cast("string").alias("grp"), "feature", "value", "n", F.lit(True).alias("is_ref")).unionByName(
        cur.select("grp", "feature", "value", "n", F.lit(False).alias("is_ref"))
    ).where("value is not null")

    parts = range_parts(both, ["feature"], "value")
    part = Window.partitionBy("feature", RANGE)
    ref_n = F.when(F.col("is_ref"), F.col("n")).otherwise(0)
    by_value = part.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    at_value = Window.partitionBy("feature", RANGE, "value")
    own_run = Window.partitionBy("feature", RANGE, "is_ref", "grp").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        parts.withColumn("ref_upto", F.sum(ref_n).over(by_value))
        .withColumn("ref_below", F.col("ref_upto") - F.sum(ref_n).over(at_value))
        .withColumn("upto", F.sum("n").over(own_run))
    )
    sizes = pair.select(F.col("grp").alias("g"), F.col("feature").alias("f"), "ref_n", "cur_n")
    gaps = runs.join(sizes, (F.col("grp") == F.col("g")) & (F.col("feature") == F.col("f")), "left")

    def share(x: Column, total: str) -> Column:
        return F.try_divide(x.cast("double"), F.col(total).cast("double"))

    after = share(F.col("ref_upto"), "ref_n") - share(F.col("upto"), "cur_n")
    before = share(F.col("ref_below"), "ref_n") - share(F.col("upto") - F.col("n"), "cur_n")
    per_part = gaps.groupBy("feature", RANGE, "is_ref", "grp").agg(
        F.sum("n").alias("n"),
        F.max("ref_n").alias("ref_n"),
        F.max("cur_n").alias("cur_n"),
        F.max(F.greatest(before, after)).alias("top"),
        F.min(F.least(before, after)).alias("bottom"),
    )
    ref_before = F.sum(F.when(F.col("is_ref"), F.col("n")).otherwise(0)).over(
        Window.partitionBy("feature").orderBy(RANGE).rangeBetween(Window.unboundedPreceding, -1)
    )
    cur_before = F.sum("n").over(
        Window.partitionBy("feature", "is_ref", "grp").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    )
    chained = (
        per_part.withColumn("ref_before", F.coalesce(ref_before, F.lit(0)))
        .withColumn("cur_before", F.coalesce(cur_before, F.lit(0)))
        .where("not is_ref")
    )
    start = share(F.col("ref_before"), "ref_n") - share(F.col("cur_before"), "cur_n")
    widest = F.greatest(F.abs(start + F.col("top")), F.abs(start + F.col("bottom")))
    d = chained.groupBy("grp", "feature").agg(F.max(widest).alias("statistic"))
    return pair.select("grp", "feature", F.col("ref_n").alias("n_ref"), F.col("cur_n").alias("n_cur")).join(
        d, ["grp", "feature"], "left"
    )


def _scaled() -> Column:
    return F.try_divide(F.col("value") - F.col("mean"), F.col("std")).alias("value")


def ks_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    threshold: float = 0.05,
    standardize: bool = True,
    by: str | None = None,
    pair: DataFrame | None = None,
    exact_up_to: int = EXACT_KS,
) -> DataFrame:
    """Each side is standardised by its own mean and deviation unless told otherwise,
    so the default reacts to a change of shape, not of place or scale.

    The p-value is exact where neither side has more than ``exact_up_to`` values, else asymptotic.
    """
    d = ks_statistic(reference, current, features, standardize, by, pair)
    small = F.greatest("n_ref", "n_cur") <= exact_up_to
    p = ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    if exact_up_to:
        gap = F.when(small, F.col("statistic"))
        p = F.when(small, ks_p_value_exact(gap, F.col("n_ref"), F.col("n_cur"))).otherwise(p)
    return d.withColumn("p_value", p).withColumn("is_drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


# -- Population stability index ----------------------------------------------


def bin_edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A flat range is widened by one half on both sides."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def bin_of(value: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """Number (from 0) of the equal-width bin; the last one is closed, outside is NULL.

    The bin is found against the edges ``lo + i * (hi - lo) / bins`` themselves,
    so a value that equals an edge opens the upper bin.
    """
    width = hi - lo
    crossed = reduce(
        lambda a, b: a + b,
        [(value >= lo + width * F.lit(float(i)) / F.lit(float(bins))).cast("int") for i in range(1, bins)],
    )
    return F.when((value >= lo) & (value <= hi), crossed)


def binned_counts(
    df: DataFrame, edges: DataFrame, features: list[str], by: str | None = None, bins: int = BINS
) -> DataFrame:
    """(grp, feature, bin, n) of the values inside the edges.

    ``edges`` is (feature, lo, hi) or (grp, feature, lo, hi): a row per feature.
    """
    on = [c for c in ("grp", "feature") if c in edges.columns]
    rows = _long(df, features, by).join(edges, on)
    return (
        rows.withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins))
        .where("bin is not null")
        .groupBy("grp", "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """Counts of every bin of each feature over its own range, empty bins included."""
    m = moments(df, features)
    lo, hi = bin_edges(F.col("min"), F.col("max"))
    edges = m.where("n > 0").select("feature", lo.alias("lo"), hi.alias("hi"))
    counts = binned_counts(df, edges, features, bins=bins).drop("grp")
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.col("hi") - F.col("lo")
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("lo") + width * F.col("bin") / F.lit(float(bins))).alias("left_edge"),
        (F.col("lo") + width * (F.col("bin") + 1) / F.lit(float(bins))).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def overlay_histogram(
    reference: DataFrame, current: DataFrame, features: list[str], bins: int = BINS
) -> DataFrame:
    """Both sides in the bins of their combined range, with each side's mean and deviation."""
    pair = paired_moments(reference, current, features)
    edges = _edges(pair, "combined").drop("grp")

    def side(df: DataFrame, name: str) -> DataFrame:
        prefix = "ref" if name == "reference" else "cur"
        own = pair.select("feature", F.col(f"{prefix}_mean").alias("mean"), F.col(f"{prefix}_std").alias("std"))
        counts = binned_counts(df, edges, features, bins=bins).drop("grp")
        return counts.join(own, "feature").select(F.lit(name).alias("side"), "feature", "bin", "n", "mean", "std")

    return side(reference, "reference").unionByName(side(current, "current"))


def _edges(pair: DataFrame, span: str) -> DataFrame:
    if span == "combined":
        raw_lo, raw_hi = F.least("ref_lo", "cur_lo"), F.greatest("ref_hi", "cur_hi")
    elif span == "reference":
        raw_lo, raw_hi = F.col("ref_lo"), F.col("ref_hi")
    else:
        raise ValueError("span is 'combined' or 'reference'")
    lo, hi = bin_edges(raw_lo, raw_hi)
    return pair.select("grp", "feature", lo.alias("lo"), hi.alias("hi")).where("lo is not null")


def psi(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    span: str = "combined",
    by: str | None = None,
    bins: int = BINS,
    pair: DataFrame | None = None,
) -> DataFrame:
    """(grp, feature, psi) over equal-width bins.

    ``span='combined'`` bins the range of both sides; ``'reference'`` bins the
    reference range and leaves current values outside it out.  An empty share
    becomes 0.0001 and the others are not rescaled.
    """
    pair = pair if pair is not None else paired_moments(reference, current, features, by)
    edges = _edges(pair, span)
    cur = binned_counts(current, edges, features, by, bins).withColumnRenamed("n", "cur_n")
    if span == "reference" or by is None:
        # One set of edges per feature serves every group.
        flat = edges.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        ref = binned_counts(reference, flat, features, bins=bins).drop("grp")
        ref = edges.select("grp", "feature").join(ref, "feature")
    else:
        ref = _reference_bins_per_group(reference, edges, features, bins)
    ref = ref.withColumnRenamed("n", "ref_n")
    grid = edges.select("grp", "feature").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    keys = ["grp", "feature", "bin"]
    full = grid.join(ref, keys, "left").join(cur, keys, "left").na.fill(0, ["ref_n", "cur_n"])
    whole = Window.partitionBy("grp", "feature")

    def share(n: str) -> Column:
        s = F.try_divide(F.col(n).cast("double"), F.sum(n).over(whole).cast("double"))
        return F.when(s == 0, EMPTY_SHARE).otherwise(s)

    shares = full.select(*keys, share("ref_n").alias("r"), share("cur_n").alias("c"))
    term = (F.col("c") - F.col("r")) * F.ln(F.try_divide(F.col("c"), F.col("r")))
    out = shares.groupBy("grp", "feature").agg(F.sum(term).alias("psi"))
    # No value inside the reference range on one side: the index counts as zero.
    return out.withColumn("psi", F.coalesce("psi", F.lit(0.0))) if span == "reference" else out


def _reference_bins_per_group(
    reference: DataFrame, edges: DataFrame, features: list[str], bins: int
) -> DataFrame:
    """Reference counts for each group's own edges.

    Counted reference values and all groups' cuts are put in one order, in range parts; the running count at a cut
    is what lies below it, and a bin holds the difference of two cuts. Work grows with values plus cuts, not with
    their product, and no row holds all cuts.
    """
    width = F.col("hi") - F.col("lo")
    inner = [F.struct(F.lit(i).alias("i"), (F.col("lo") + width * F.lit(float(i)) / F.lit(float(bins))).alias("value")) for i in range(1, bins)]
    cuts = edges.select("grp", "feature", F.explode(F.array(*inner)).alias("c")).select("feature", "c.value", F.lit(0).cast("long").alias("n"), "grp", "c.i")
    counted = _long(reference, features, None).drop("grp").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    rows = counted.select("feature", "value", "n", none.cast("string").alias("grp"), none.cast("int").alias("i")).unionByName(cuts)
    parts = materialize(range_parts(rows, ["feature"], "value"), "cut_parts")
    # A value that equals a cut opens the upper bin, so the cut comes first.
    inside = Window.partitionBy("feature", RANGE).orderBy("value", F.col("i").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("feature").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("feature", RANGE).agg(F.sum("n").alias("m"))
    starts = totals.select("feature", RANGE, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("feature")).alias("all"))
    placed = parts.withColumn("upto", F.sum("n").over(inside)).where("i IS NOT NULL").join(starts, ["feature", RANGE])
    below = placed.groupBy("grp", "feature").agg(
        F.sort_array(F.collect_list(F.struct("i", (F.col("before") + F.col("upto")).alias("below")))).alias("cuts"), F.max("all").alias("all")
    )
    upto = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.below"), F.array("all"))
    held = below.select("grp", "feature", upto.alias("upto")).select("grp", "feature", "upto", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return held.select("grp", "feature", "bin", (F.get("upto", F.col("bin") + 1) - F.get("upto", F.col("bin"))).alias("n"))


def psi_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    threshold: float = 0.1,
    span: str = "combined",
    by: str | None = None,
    pair: DataFrame | None = None,
) -> DataFrame:
    out = psi(reference, current, features, span, by, pair=pair)
    return out.withColumn("is_drift", F.coalesce(F.col("psi") > threshold, F.lit(False))).withColumn(
        "interpretation", psi_label(F.col("psi"))
    )


# -- Welch t -----------------------------------------------------------------


def welch(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    by: str | None = None,
    pair: DataFrame | None = None,
) -> DataFrame:
    """(grp, feature, statistic, df): sign of the statistic is reference minus current."""
    a = F.try_divide(F.col("ref_var"), F.col("ref_n").cast("double"))
    b = F.try_divide(F.col("cur_var"), F.col("cur_n").cast("double"))
    t = F.try_divide(F.col("ref_mean") - F.col("cur_mean"), F.sqrt(a + b))
    df = F.try_divide(
        (a + b) * (a + b),
        F.try_divide(a * a, F.col("ref_n") - F.lit(1.0)) + F.try_divide(b * b, F.col("cur_n") - F.lit(1.0)),
    )
    pair = pair if pair is not None else paired_moments(reference, current, features, by)
    return pair.select("grp", "feature", t.alias("statistic"), df.alias("df"))


def welch_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    threshold: float = 0.05,
    by: str | None = None,
    pair: DataFrame | None = None,
) -> DataFrame:
    out = welch(reference, current, features, by, pair)
    p = welch_p_value(F.col("statistic"), F.col("df"))
    return out.withColumn("p_value", p).withColumn("is_drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


# -- Combined runs -----------------------------------------------------------


def detect_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str] | None = None,
    methods: Iterable[str] = ("ks", "psi", "ttest"),
    thresholds: dict[str, float] | None = None,
    preset: str | None = None,
    by: str | None = None,
) -> DataFrame:
    """The chosen methods as one long table.

    Features default to the numeric columns of both tables. A named feature that the current table lacks is
    not compared; it is a row of method ``skipped`` without values, which votes for nothing.
    """
    features = list(features) if features is not None else common_numeric_columns(reference, current)
    features, skipped = usable_features(current, features)
    methods = list(methods)
    unknown = set(methods) - set(DEFAULT_THRESHOLDS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    limits = {**DEFAULT_THRESHOLDS, **(PRESETS[preset] if preset else {}), **(thresholds or {})}
    none = F.lit(None)
    number, text = none.cast("double"), none.cast("string")
    pair = paired_moments(reference, current, features, by)
    tables = []
    for method in methods:
        limit = limits[method]
        if method == "ks":
            r = ks_drift(reference, current, features, limit, True, by, pair)
            parts = (F.col("statistic"), F.col("p_value"), number, text)
        elif method == "psi":
            r = psi_drift(reference, current, features, limit, "combined", by, pair)
            parts = (number, number, F.col("psi"), F.col("interpretation"))
        else:
            r = welch_drift(reference, current, features, limit, by, pair)
            parts = (F.col("statistic"), F.col("p_value"), number, text)
        statistic, p_value, index, label = parts
        tables.append(
            r.select(
                *(["grp"] if by else []),
                F.lit(method).alias("method"),
                "feature",
                statistic.alias("statistic"),
                p_value.alias("p_value"),
                index.alias("psi"),
                "is_drift",
                F.lit(float(limit)).alias("threshold"),
                label.alias("interpretation"),
            )
        )
    found = reduce(DataFrame.unionByName, tables)
    if skipped:
        spark = reference.sparkSession
        rows = [("skipped", name, False, "missing in the current table") for name in skipped]
        found = found.unionByName(spark.createDataFrame(rows, "method string, feature string, is_drift boolean, interpretation string"), allowMissingColumns=True)
    return found


def drift_votes(results: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """How many methods flag each feature (of each group); only flagged ones are kept."""
    return (
        results.groupBy(*by, "feature")
        .agg(F.count_if("is_drift").alias("n_votes"))
        .where("n_votes > 0")
    )


def drift_summary(results: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """One row (per group): drifted features, those flagged by more than one method, flag and action."""
    flagged = F.col("n_votes") > 0
    by = list(by)
    return (
        results.groupBy(*by, "feature")
        .agg(F.count_if("is_drift").alias("n_votes"))
        .groupBy(*by)
        .agg(
            F.count_if(flagged).alias("total_drifted_features"),
            F.array_sort(F.collect_list(F.when(flagged, F.col("feature")))).alias("drifted_features"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.when(F.col("n_votes") > 1, F.struct("feature", "n_votes"))))
            ).alias("feature_drift_consensus"),
        )
        .withColumn("overall_drift_detected", F.col("total_drifted_features") > 0)
        .withColumn("recommended_action", drift_action(F.col("total_drifted_features")))
    )


def drift_report(results: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Per method (and group): how many features were looked at, and the details of the drifted ones."""
    detail = F.struct("feature", "statistic", "p_value", "psi", "threshold", "interpretation")
    return results.groupBy(*by, "method").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if("is_drift").alias("n_drifted"),
        F.array_sort(F.collect_list(F.when(F.col("is_drift"), detail))).alias("drifted"),
    )


def dashboard_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str] | None = None,
    p_limit: float = 0.05,
    psi_limit: float = 0.1,
) -> DataFrame:
    """Raw-value KS or reference-range PSI flags a feature; small samples are left out."""
    features = features or common_numeric_columns(reference, current)
    pair = paired_moments(reference, current, features)
    ks = ks_drift(reference, current, features, p_limit, standardize=False, pair=pair)
    index = psi(reference, current, features, "reference", pair=pair).select("grp", "feature", "psi")
    return (
        enough_rows(ks)
        .join(index, ["grp", "feature"])
        .select(
            "feature",
            "psi",
            F.col("p_value").alias("ks_p_value"),
            (F.coalesce(F.col("p_value") < p_limit, F.lit(False)) | (F.col("psi") > psi_limit)).alias("is_drift"),
        )
    )


def dashboard_summary(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if("is_drift").alias("n_drifted")
    ).withColumn("severity", drift_severity(F.col("n_drifted")))


def monitoring_record(results: DataFrame, method: str = "psi", by: Iterable[str] = ()) -> DataFrame:
    """One record (per group) for a monitoring log, with the retrain flag."""
    by = list(by)
    mine = results.where(F.col("method") == method)
    return (
        mine.groupBy(*by).agg(
            F.array_sort(F.collect_list(F.when(F.col("is_drift"), F.col("feature")))).alias("drifted_features"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("psi_scores"),
        )
        .withColumn("n_drifted", F.size("drifted_features").cast("bigint"))
        .select(
            *by,
            F.current_timestamp().alias("timestamp"),
            F.lit(method).alias("detection_method"),
            "drifted_features",
            "n_drifted",
            drift_severity(F.col("n_drifted")).alias("drift_severity"),
            drift_action(F.col("n_drifted")).alias("recommended_action"),
            "psi_scores",
            (F.col("n_drifted") > 0).alias("should_retrain"),
        )
    )


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week of ``ts``; the offset moves the epoch's Thursday."""
    monday = F.date_sub(ts.cast("date"), F.weekday(ts))
    return monday.cast("timestamp_ntz")


def moment_change(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Mean over the features of (current - reference) mean and standard deviation."""
    pair = paired_moments(reference, current, features)
    return pair.agg(
        F.avg(F.col("cur_mean") - F.col("ref_mean")).alias("mean_change"),
        F.avg(F.col("cur_std") - F.col("ref_std")).alias("std_change"),
    )


def enough_rows(counts: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    """Pairs with enough values on both sides."""
    return counts.where((F.col("n_ref") >= minimum) & (F.col("n_cur") >= minimum))


def judge_presets(results: DataFrame, presets: dict[str, dict[str, float]] = PRESETS) -> DataFrame:
    """One result table judged under every named set of thresholds."""
    limits = F.create_map(
        *[
            x
            for name, by_method in presets.items()
            for x in (F.lit(name), F.create_map(*[y for m, v in by_method.items() for y in (F.lit(m), F.lit(v))]))
        ]
    )
    rows = results.drop("threshold", "is_drift").select("*", F.explode(limits).alias("preset", "limits"))
    limit = F.col("limits")[F.col("method")]
    flag = F.when(F.col("method") == "psi", F.col("psi") > limit).otherwise(F.col("p_value") < limit)
    return rows.withColumn("threshold", limit).withColumn("is_drift", F.coalesce(flag, F.lit(False))).drop("limits")
