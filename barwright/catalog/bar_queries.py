"""Bars, indicators, labels, split, scaling, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.catalog.inputs import (
    Registry,
    bars,
    bars_by_type,
    bars_by_user,
    bars_sql,
    feats_sql,
    full,
    prep_sql,
    prepared_by_type,
    r,
    rounded,
    rs,
    split_sql,
    table,
)
from barwright.functions.rules import rsi_zone
from barwright.operators import prepare as prep
from barwright.operators import profile, ranking
from barwright.operators.drift import histogram
from barwright.operators.indicators import (
    DECLARED,
    add_declared_features,
    add_delta,
    add_ema,
    add_indicators,
    add_target,
    add_true_range,
)
from barwright.operators.layout import Layout, with_row_index
from barwright.schema import INDICATORS, MODEL_FEATURES, feature_columns
from barwright.session import materialize

REGISTRY = Registry()
query = REGISTRY.query

KEYS = ["series_id", "ts"]


def _columns(names):
    def run(spark, d):
        return rounded(add_indicators(bars_by_type(spark, d), names).select(*KEYS, *names))

    return run


def _feats(names):
    return f"WITH {feats_sql()} SELECT series_id, ts, {rs(*names)} FROM feats"


# Indicators one by one: only the asked-for columns are computed.
for _name, _cols in {
    "w01_volatility": ["volatility_5", "volatility_10"],
    "w02_returns": ["returns"],
    "w03_log_returns": ["log_returns"],
    "w04_bollinger_bands": ["bb_upper", "bb_lower"],
    "w05_band_position": ["bb_position"],
    "w07_relative_strength": ["rsi"],
    "w09_average_true_range": ["atr"],
    "w10_volume_ratio": ["volume_sma", "volume_ratio"],
    "w11_momentum": ["momentum_5", "momentum_10"],
    "w12_gap": ["gap"],
    "f01_high_low_ratio": ["high_low_ratio"],
    "f02_close_open_ratio": ["close_open_ratio"],
    "f03_body_size": ["body_size"],
}.items():
    query(_name, _feats(_cols))(_columns(_cols))


@query("w06_first_difference", f"WITH {feats_sql()} SELECT series_id, ts, {r('delta')} FROM feats")
def _(spark, d):
    return rounded(add_delta(bars_by_type(spark, d)).select(*KEYS, "delta"))


@query("w08_true_range", f"WITH {feats_sql()} SELECT series_id, ts, {r('tr', 'true_range')} FROM feats")
def _(spark, d):
    return rounded(add_true_range(bars_by_type(spark, d)).select(*KEYS, "true_range"))


_all_user = f"WITH {feats_sql('user_id')} SELECT series_id, ts, {rs(*INDICATORS)}, target FROM feats"


@query("w13_indicator_set", _all_user)
def _(spark, d):
    """All seventeen outputs and the label for every user's series (gaps included)."""
    return rounded(add_indicators(bars_by_user(spark, d), label=True).select(*KEYS, *INDICATORS, "target"))


@query("w13_indicator_set_split_buckets", _all_user)
def _(spark, d):
    """The same with day-long buckets: most frames reach over several of them."""
    small = Layout(slice_bars=4, slices_per_bucket=6)
    return rounded(add_indicators(bars_by_user(spark, d), layout=small, label=True).select(*KEYS, *INDICATORS, "target"))


@query("w13_indicator_set_one_series", f"WITH {feats_sql(chr(39) + 'ALL' + chr(39))} SELECT series_id, ts, {rs(*INDICATORS)}, target FROM feats")
def _(spark, d):
    """All events in one series, cut into buckets of ninety-six hours."""
    small = Layout(slice_bars=8, slices_per_bucket=12)
    return rounded(add_indicators(bars(spark, d), layout=small, label=True).select(*KEYS, *INDICATORS, "target"))


@query("w14_next_row_label", f"WITH {feats_sql()} SELECT series_id, ts, target FROM feats WHERE nxt IS NOT NULL")
def _(spark, d):
    return add_target(bars_by_type(spark, d), drop_last=True).select(*KEYS, "target")


@query("p04_label", f"WITH {feats_sql()} SELECT series_id, ts, close, target FROM feats")
def _(spark, d):
    return add_target(bars_by_type(spark, d)).select(*KEYS, "close", "target")


@query("w15_time_split", f"WITH {split_sql()} SELECT series_id, ts, row_id, n_rows, split, target FROM split_rows")
def _(spark, d):
    return prep.prepare_split(bars_by_type(spark, d)).select(*KEYS, "row_id", "n_rows", "split", "target")


@query(
    "w16_row_index",
    f"WITH {bars_sql('user_id')} SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS row_id FROM bars",
)
def _(spark, d):
    small = Layout(slice_bars=12, slices_per_bucket=4)
    return with_row_index(bars_by_user(spark, d), small).select(*KEYS, "row_id")


# -- declared features ---------------------------------------------------------


def _lag(k: int) -> str:
    return f"lag(close, {k}) OVER (PARTITION BY series_id ORDER BY ts)"


def _declared_sql(names, extra=""):
    ret = f"close / nullif({_lag(1)}, 0) - 1"
    lo, hi = full("min", "low", 14), full("max", "high", 14)
    exprs = {f"returns_{k}h": f"close / nullif({_lag(k)}, 0) - 1" for k in (1, 2, 4, 8, 24)}
    exprs |= {f"volatility_{k}h": full("stddev_samp", "ret", k) for k in (4, 8, 24)}
    exprs |= {f"ma_{k}": full("avg", "close", k) for k in (5, 10, 20, 50)}
    exprs["momentum_20"] = f"close - {_lag(20)}"
    exprs |= {f"roc_{k}": f"100 * (close / nullif({_lag(k)}, 0) - 1)" for k in (5, 10)}
    exprs["bb_middle"] = full("avg", "close", 20)
    exprs["bb_width"] = f"4 * ({full('stddev_samp', 'close', 20)})"
    exprs["stoch_k"] = "k"
    exprs["stoch_d"] = full("avg", "k", 3)
    exprs |= {f"volume_ma_{k}": full("avg", "volume", k) for k in (5, 20)}
    shown = ", ".join(r(exprs[n], n) for n in names)
    return f"""WITH {bars_sql()},
one AS (SELECT *, {ret} AS ret, 100 * (close - ({lo})) / nullif(({hi}) - ({lo}), 0) AS k FROM bars)
SELECT series_id, ts, {shown} FROM one"""


def _declared(names):
    def run(spark, d):
        return rounded(add_declared_features(bars_by_type(spark, d), names).select(*KEYS, *names))

    return run


for _name, _cols in {
    "w20_horizon_returns": [c for c in DECLARED if c.startswith("returns")],
    "w21_return_volatility": [c for c in DECLARED if c.startswith("volatility")],
    "w22_moving_averages": [c for c in DECLARED if c.startswith("ma_")],
    "w24_momentum_and_rate_of_change": ["momentum_20", "roc_5", "roc_10"],
    "w25_band_middle_and_width": ["bb_middle", "bb_width"],
    "w26_stochastic": ["stoch_k", "stoch_d"],
    "w27_volume_averages": ["volume_ma_5", "volume_ma_20"],
}.items():
    query(_name, _declared_sql(_cols))(_declared(_cols))


_spans = {5: "e5", 10: "e10", 20: "e20", 12: "e12", 26: "e26"}
_step = {s: f"x.{n} + 2.0::DOUBLE / {s + 1} * (b.close - x.{n})" for s, n in _spans.items()}


def _ema_sql(series: str) -> str:
    return f"""WITH RECURSIVE {bars_sql(series)},
b AS (SELECT series_id, ts, close, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n FROM bars),
x AS (
  SELECT series_id, ts, n, close AS e5, close AS e10, close AS e20, close AS e12, close AS e26, 0.0::DOUBLE AS sig
  FROM b WHERE n = 1
  UNION ALL
  SELECT b.series_id, b.ts, b.n, {', '.join(f'{_step[s]}' for s in _spans)},
         x.sig + 0.2::DOUBLE * (({_step[12]}) - ({_step[26]}) - x.sig)
  FROM x JOIN b ON b.series_id = x.series_id AND b.n = x.n + 1)
SELECT series_id, ts, {', '.join(r(n, f'ema_{s}') for s, n in _spans.items())}, {r('e12 - e26', 'macd')}, {r('sig', 'macd_signal')}
FROM x"""


_ema_names = [*KEYS, *[f"ema_{s}" for s in _spans], "macd", "macd_signal"]


@query("w23_exponential_averages", _ema_sql("event_type"))
def _(spark, d):
    return rounded(add_ema(bars_by_type(spark, d)).select(*_ema_names))


@query("w23_exponential_averages_by_user", _ema_sql("user_id"))
def _(spark, d):
    """Over a table that grows with the events."""
    return rounded(add_ema(bars_by_user(spark, d)).select(*_ema_names))


@query("w23_exponential_averages_split_buckets", _ema_sql("event_type"))
def _(spark, d):
    """In buckets of two days, whose states are chained."""
    small = Layout(slice_bars=8, slices_per_bucket=6)
    return rounded(add_ema(bars_by_type(spark, d), small).select(*_ema_names))


@query(
    "w28_calendar",
    f"""WITH {bars_sql()}
SELECT series_id, ts, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM bars""",
)
def _(spark, d):
    names = ["hour", "day_of_week", "is_weekend"]
    return add_declared_features(bars_by_type(spark, d), names).select(*KEYS, *names)


@query(
    "f12_rsi_zone",
    f"""WITH {feats_sql()} SELECT CASE WHEN round(rsi, 6) > 30 AND round(rsi, 6) < 70 THEN 'neutral' ELSE 'extreme' END AS zone, count(*) AS n
FROM feats WHERE rsi IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    rows = add_indicators(bars_by_type(spark, d), ["rsi"]).where("rsi is not null")
    return rows.groupBy(rsi_zone(F.round("rsi", 6)).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_conditional_replace", f"WITH {feats_sql()} SELECT series_id, ts, CASE WHEN delta > 0 THEN {r('delta').split(' AS ')[0]} ELSE 0.0::DOUBLE END AS gain, CASE WHEN delta < 0 THEN {r('-delta').split(' AS ')[0]} ELSE 0.0::DOUBLE END AS loss FROM feats")
def _(spark, d):
    x = F.col("delta")
    rows = add_delta(bars_by_type(spark, d))
    return rounded(
        rows.select(*KEYS, F.when(x > 0, x).otherwise(0.0).alias("gain"), F.when(x < 0, -x).otherwise(0.0).alias("loss"))
    )


# -- cleaning, checks ------------------------------------------------------------


@query("p01_feature_projection", f"WITH {prep_sql()} SELECT {rs(*MODEL_FEATURES)} FROM prep")
def _(spark, d):
    p = prepared_by_type(spark, d)
    return rounded(p.select(*feature_columns(p.columns)))


@query("p02_drop_null_rows", f"WITH {prep_sql('user_id')} SELECT series_id, ts, {rs('close', 'rsi', 'bb_position')}, target FROM prep")
def _(spark, d):
    rows = prep.drop_null_rows(add_indicators(bars_by_user(spark, d), label=True))
    return rounded(rows.select(*KEYS, "close", "rsi", "bb_position", "target"))


@query(
    "p03_null_drop_per_column",
    f"""WITH {feats_sql()}
SELECT feature, count(value) AS n, {r('avg(value)', 'mean')}
FROM (UNPIVOT feats ON {', '.join(INDICATORS)} INTO NAME feature VALUE value) GROUP BY feature""",
)
def _(spark, d):
    m = profile.moments(add_indicators(bars_by_type(spark, d)), INDICATORS)
    return rounded(m.select("feature", "n", "mean"))


@query(
    "p08_required_columns",
    f"""WITH {bars_sql()}
SELECT 'ts' AS column_name, count(ts) AS n_values, true AS is_present FROM bars UNION ALL
SELECT 'open', count(open), true FROM bars UNION ALL SELECT 'high', count(high), true FROM bars UNION ALL
SELECT 'low', count(low), true FROM bars UNION ALL SELECT 'close', count(close), true FROM bars UNION ALL
SELECT 'volume', count(volume), true FROM bars UNION ALL SELECT 'volume_usd', 0::BIGINT, false""",
)
def _(spark, d):
    return prep.required_columns(bars_by_type(spark, d), (*prep.REQUIRED, "volume_usd"))


@query(
    "p09_ohlc_rules",
    f"""WITH {bars_sql('user_id')}
SELECT rule, (SELECT count(*) FROM bars) AS n_rows, n_violations FROM (
  SELECT 'high_ge_open' AS rule, count(*) FILTER (WHERE NOT high >= open) AS n_violations FROM bars UNION ALL
  SELECT 'high_ge_close', count(*) FILTER (WHERE NOT high >= close) FROM bars UNION ALL
  SELECT 'high_ge_low', count(*) FILTER (WHERE NOT high >= low) FROM bars UNION ALL
  SELECT 'low_le_open', count(*) FILTER (WHERE NOT low <= open) FROM bars UNION ALL
  SELECT 'low_le_close', count(*) FILTER (WHERE NOT low <= close) FROM bars)""",
)
def _(spark, d):
    return prep.ohlc_violations(bars_by_user(spark, d))


@query(
    "p10_repair_ohlc",
    f"WITH {bars_sql('user_id')} SELECT series_id, ts, {r('greatest(open, high, close) + 100', 'high')}, {r('least(open, low, close) - 100', 'low')} FROM bars",
)
def _(spark, d):
    return rounded(prep.repair_ohlc(bars_by_user(spark, d)).select(*KEYS, "high", "low"))


_short = "series_id = 'error' AND close > open"


@query(
    "p11_feature_width",
    f"""WITH {bars_sql()}
SELECT series_id, CASE WHEN {_short} THEN 'rejected' ELSE 'valid' END AS verdict, count(*) AS n_rows,
       {r('sum(open)', 'sum_open')}
FROM bars GROUP BY 1, 2""",
)
def _(spark, d):
    """Arrays of five numbers; rising bars of one series are sent one short."""
    width = F.when((F.col("series_id") == "error") & (F.col("close") > F.col("open")), 4).otherwise(5)
    vectors = bars_by_type(spark, d).select(
        *KEYS, F.slice(F.array("open", "high", "low", "close", "volume"), F.lit(1), width).alias("features")
    )
    good, bad = prep.split_by_width(vectors, 5)
    both = good.withColumn("verdict", F.lit("valid")).unionByName(bad.withColumn("verdict", F.lit("rejected")))
    out = both.groupBy("series_id", "verdict").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("features")[0]).alias("sum_open")
    )
    return rounded(out)


@query("p13_drop_target", f"WITH {prep_sql()} SELECT series_id, ts, {rs(*MODEL_FEATURES)} FROM prep")
def _(spark, d):
    return rounded(prepared_by_type(spark, d).drop("target"))


# -- joins -----------------------------------------------------------------------


@query("j01_target_join", f"WITH {feats_sql()} SELECT series_id, ts, {rs('rsi', 'atr')}, target FROM feats")
def _(spark, d):
    """Features and labels held apart, aligned by their key."""
    b = bars_by_type(spark, d)
    x = add_indicators(b, ["rsi", "atr"]).select(*KEYS, "rsi", "atr")
    y = add_target(b).select(*KEYS, "target")
    return rounded(x.join(y, KEYS))


_j03 = ["open", "close", "volume"]


@query(
    "j03_column_scalars",
    f"""WITH {bars_sql('user_id')},
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in _j03)} FROM bars)
SELECT series_id, ts, {', '.join(r(f'({c} - m_{c}) / s_{c}', c) for c in _j03)} FROM bars, s""",
)
def _(spark, d):
    b = bars_by_user(spark, d)
    return rounded(prep.apply_scaler(b, prep.fit_scaler(b, _j03), _j03).select(*KEYS, *_j03))


# -- profiling ---------------------------------------------------------------------


@query("a01_class_counts", f"WITH {prep_sql()} SELECT target, count(*) AS n FROM prep GROUP BY target")
def _(spark, d):
    return profile.class_distribution(prepared_by_type(spark, d))


@query(
    "a02_class_balance",
    f"""WITH {prep_sql()}
SELECT count(*) AS n_rows, {r('avg(target)', 'positive_ratio')}, {r('100 - 100 * avg(target)', 'pct_down')},
       {r('100 * avg(target)', 'pct_up')}, abs(50 - 100 * avg(target)) > 10 AS is_imbalanced FROM prep""",
)
def _(spark, d):
    return rounded(profile.class_balance(prepared_by_type(spark, d)))


_describe_sql = f"""WITH {prep_sql()}
SELECT feature, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')},
       {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.5)', 'median')},
       {r('quantile_cont(value, 0.75)', 'q3')}, {r('max(value)', 'max')}
FROM (UNPIVOT prep ON {', '.join(MODEL_FEATURES)} INTO NAME feature VALUE value) GROUP BY feature"""


@query("a03_describe", _describe_sql)
def _(spark, d):
    return rounded(profile.describe(materialize(prepared_by_type(spark, d)), MODEL_FEATURES))


_null_cols = ["series_id", "ts", *INDICATORS]


@query(
    "a04_null_counts",
    f"""WITH {feats_sql('user_id')},
w AS (SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in _null_cols)} FROM feats),
l AS (UNPIVOT w ON {', '.join(_null_cols)} INTO NAME feature VALUE n_missing)
SELECT feature, n_missing FROM l UNION ALL SELECT '(all)', sum(n_missing)::BIGINT FROM l""",
)
def _(spark, d):
    return profile.null_counts(add_indicators(bars_by_user(spark, d)).select(*_null_cols))


def _corr_sql(tail=""):
    return f"""WITH {prep_sql()}
SELECT feature, {r('abs(covar_samp(value, target) / nullif(stddev_samp(value) * stddev_samp(target), 0))', 'abs_corr')}
FROM (UNPIVOT prep ON {', '.join(MODEL_FEATURES)} INTO NAME feature VALUE value) GROUP BY feature{tail}"""


@query("a05_target_correlation", _corr_sql())
def _(spark, d):
    return rounded(profile.target_correlation(prepared_by_type(spark, d), MODEL_FEATURES))


@query("a06_table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(spark, d):
    return profile.shape(table(spark, d, "lineitem"))


@query("t02_top_correlations", _corr_sql(" ORDER BY abs_corr DESC, feature LIMIT 10"))
def _(spark, d):
    c = rounded(profile.target_correlation(prepared_by_type(spark, d), MODEL_FEATURES))
    return ranking.top_by(c, "abs_corr", 10, "feature")


def _scaler_sql(where=""):
    return f"""
stats AS (
  SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS std
  FROM (UNPIVOT split_rows ON {', '.join(MODEL_FEATURES)} INTO NAME feature VALUE value) {where} GROUP BY feature)"""


@query("a08_scaler_fit", f"WITH {split_sql()},{_scaler_sql()} SELECT feature, {rs('mean', 'std')} FROM stats")
def _(spark, d):
    return rounded(prep.fit_scaler(prepared_by_type(spark, d)))


def _scaled_sql(where=""):
    wide = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in MODEL_FEATURES
    )
    shown = ", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in MODEL_FEATURES)
    return f"""WITH {split_sql()}, s AS (SELECT {wide} FROM split_rows {where})
SELECT series_id, ts, split, {shown} FROM split_rows, s"""


@query("a09_scale_on_train", _scaled_sql("WHERE split = 'train'"))
def _(spark, d):
    out = prep.scale_features(prep.prepare_split(bars_by_type(spark, d)), fit_on="train")
    return rounded(out.select(*KEYS, "split", *MODEL_FEATURES))


@query("a09_scale_on_all", _scaled_sql())
def _(spark, d):
    out = prep.scale_features(prep.prepare_split(bars_by_type(spark, d)), fit_on="all")
    return rounded(out.select(*KEYS, "split", *MODEL_FEATURES))


@query(
    "a16_class_weights",
    f"""WITH {prep_sql()}
SELECT target, count(*) AS n, {r('(SELECT count(*) FROM prep) / (2.0::DOUBLE * count(*))', 'weight')} FROM prep GROUP BY target""",
)
def _(spark, d):
    return rounded(prep.class_weights(prepared_by_type(spark, d)))


_hist = ["rsi", "bb_position", "volume_ratio"]


@query(
    "a17_histogram",
    f"""WITH {prep_sql()},
long AS (SELECT feature, round(value, 6) + 0.0 AS value FROM (UNPIVOT prep ON {', '.join(_hist)} INTO NAME feature VALUE value)),
e AS (SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
             CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM long GROUP BY feature),
g AS (SELECT feature, lo, hi, unnest(range(0, 10)) AS bin FROM e),
ed AS (SELECT feature, bin, lo + (hi - lo) * bin::DOUBLE / 10.0::DOUBLE AS a, lo + (hi - lo) * (bin + 1)::DOUBLE / 10.0::DOUBLE AS b FROM g)
SELECT ed.feature, ed.bin::INTEGER AS bin, {r('ed.a', 'left_edge')}, {r('ed.b', 'right_edge')}, count(l.value) AS n
FROM ed LEFT JOIN long l ON l.feature = ed.feature AND l.value >= ed.a AND (l.value < ed.b OR ed.bin = 9)
GROUP BY ed.feature, ed.bin, ed.a, ed.b""",
)
def _(spark, d):
    p = materialize(rounded(prepared_by_type(spark, d).select(*_hist)))
    return rounded(histogram(p, _hist))


# -- sorts and limits ----------------------------------------------------------------


@query("t01_time_sort", f"WITH {bars_sql('user_id')} SELECT series_id, ts, close FROM bars ORDER BY ts, series_id")
def _(spark, d):
    return ranking.sort_by_time(bars_by_user(spark, d)).select(*KEYS, "close")


@query("t05_last_rows", f"WITH {bars_sql('user_id')} SELECT series_id, ts, close FROM bars ORDER BY ts DESC, series_id DESC LIMIT 10")
def _(spark, d):
    return ranking.last_rows(bars_by_user(spark, d), 10).select(*KEYS, "close")


@query(
    "t05_last_rows_per_series",
    f"WITH {bars_sql('user_id')} SELECT series_id, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 5",
)
def _(spark, d):
    return ranking.last_rows_per_series(bars_by_user(spark, d), 5).select(*KEYS, "close")


@query("t06_first_rows", f"WITH {bars_sql('user_id')} SELECT * FROM bars ORDER BY ts, series_id LIMIT 100")
def _(spark, d):
    return ranking.first_rows(bars_by_user(spark, d), 100)


@query(
    "t08_repeatable_sample",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5('42:' || l_orderkey), 1, 8))::BIGINT % 10000 < 5000",
)
def _(spark, d):
    return prep.sample_rows(table(spark, d, "lineitem"), "l_orderkey", 0.5).select("l_orderkey", "l_linenumber")


@query(
    "m04_stratified_folds",
    f"""WITH {prep_sql()},
c AS (SELECT target, count(*) AS n FROM prep GROUP BY target),
s AS (SELECT target, CASE WHEN target = 0 THEN 0 ELSE coalesce((SELECT n FROM c WHERE target = 0), 0) END AS off, n FROM c),
cut AS (
  SELECT target, len([x for x in range(off, off + n) if x % 3 = 0]) AS c0, len([x for x in range(off, off + n) if x % 3 <= 1]) AS c1 FROM s),
k AS (SELECT series_id, ts, target, row_number() OVER (PARTITION BY target ORDER BY ts, series_id) - 1 AS p FROM prep)
SELECT series_id, ts, target, CASE WHEN p < c0 THEN 0 WHEN p < c1 THEN 1 ELSE 2 END AS fold FROM k JOIN cut USING (target)""",
)
def _(spark, d):
    return prep.stratified_folds(prepared_by_type(spark, d), 3).select(*KEYS, "target", "fold")
