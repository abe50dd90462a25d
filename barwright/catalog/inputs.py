"""Inputs shared by the registered queries, in Spark and in SQL.

Every input derives from the given tables.  The SQL texts are written on their
own, from the definitions, and share no code with the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.operators.prepare import prepare
from barwright.schema import MODEL_FEATURES
from barwright.sources.bars import hourly_bars

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


class Registry(dict):
    def query(self, name: str, sql: str | None = None):
        def add(fn: Query) -> Query:
            self[name] = Entry(fn, sql.strip() if sql else None)
            return fn

        return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of decimals that both engines agree on."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# -- bars ---------------------------------------------------------------------


def bars(spark: SparkSession, d: str, series: Column | None = None) -> DataFrame:
    return hourly_bars(table(spark, d, "events"), series)


def bars_by_type(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d, F.col("event_type"))


def bars_by_user(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d, F.col("user_id"))


def prepared_by_type(spark: SparkSession, d: str) -> DataFrame:
    return prepare(bars_by_type(spark, d))


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL rounding that has no negative zero."""
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def bars_sql(series: str = "event_type") -> str:
    return f"""
bars AS (
  SELECT CAST({series} AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""


def _frame(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} = {n} THEN {agg}({x}) OVER {_frame(n)} END"


def feats_sql(series: str = "event_type") -> str:
    """bars, then feats with every indicator and the target."""
    w = "(PARTITION BY series_id ORDER BY ts)"
    return f"""{bars_sql(series)},
lagged AS (
  SELECT *, lag(close) OVER {w} AS prev, lag(close, 5) OVER {w} AS c5, lag(close, 10) OVER {w} AS c10,
         lead(close) OVER {w} AS nxt
  FROM bars),
steps AS (
  SELECT *, close - prev AS delta,
         CASE WHEN close - prev > 0 THEN close - prev ELSE 0.0::DOUBLE END AS gain,
         CASE WHEN close - prev < 0 THEN prev - close ELSE 0.0::DOUBLE END AS loss,
         greatest(high - low, abs(high - prev), abs(low - prev)) AS tr
  FROM lagged),
rolled AS (
  SELECT *, {full('stddev_samp', 'close', 5)} AS volatility_5,
         {full('stddev_samp', 'close', 10)} AS volatility_10,
         {full('avg', 'gain', 14)} AS ag, {full('avg', 'loss', 14)} AS al,
         {full('avg', 'close', 20)} AS sma, {full('stddev_samp', 'close', 20)} AS sd,
         {full('avg', 'tr', 14)} AS atr, {full('avg', 'volume', 20)} AS volume_sma
  FROM steps),
feats AS (
  SELECT series_id, ts, open, high, low, close, volume, delta, tr, prev, nxt,
         volatility_5, volatility_10,
         close / nullif(prev, 0) - 1 AS returns,
         CASE WHEN close / nullif(prev, 0) > 0 THEN ln(close / nullif(prev, 0)) END AS log_returns,
         CASE WHEN al = 0 AND ag > 0 THEN 100.0::DOUBLE WHEN al = 0 THEN NULL
              ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi,
         sma + 2 * sd AS bb_upper, sma - 2 * sd AS bb_lower,
         (close - (sma - 2 * sd)) / nullif((sma + 2 * sd) - (sma - 2 * sd), 0) AS bb_position,
         atr, volume_sma, volume / (volume_sma + 1e-8) AS volume_ratio,
         close - c5 AS momentum_5, close - c10 AS momentum_10,
         high / nullif(low, 0) AS high_low_ratio, close / nullif(open, 0) AS close_open_ratio,
         abs(close - open) / nullif(open, 0) AS body_size,
         (open - prev) / nullif(prev, 0) AS gap,
         CAST(coalesce(nxt > close, false) AS INTEGER) AS target
  FROM rolled)"""


def prep_sql(series: str = "event_type") -> str:
    """feats, then prep: complete rows only."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES)
    return f"""{feats_sql(series)},
prep AS (SELECT series_id, ts, {', '.join(MODEL_FEATURES)}, target FROM feats WHERE {complete})"""


def split_sql(series: str = "event_type") -> str:
    """prep, then split_rows with the position in the series and the split name."""
    return f"""{prep_sql(series)},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS row_id,
         count(*) OVER (PARTITION BY series_id) AS n_rows FROM prep),
split_rows AS (
  SELECT *, CASE WHEN row_id >= n_rows - ceil(0.2::DOUBLE * n_rows) THEN 'test' ELSE 'train' END AS split
  FROM numbered)"""


# -- predictions of three rule-based scorers -----------------------------------

RULES = ("rsi", "contrarian", "band")


def wide_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = prepared_by_type(spark, d)
    return p.select(
        "series_id",
        "ts",
        F.col("target").alias("y"),
        F.round(F.col("rsi") / 100, 6).alias("rsi"),
        F.round(F.lit(1.0) - F.col("rsi") / 100, 6).alias("contrarian"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bb_position"))), 6).alias("band"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, ts, model, y, score, pred) of the rule-based scorers."""
    long = wide_predictions(spark, d).unpivot(["series_id", "ts", "y"], list(RULES), "model", "score")
    return long.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def wide_predictions_sql() -> str:
    return f"""{prep_sql()},
scored AS (
  SELECT series_id, ts, target AS y, round(rsi / 100, 6) AS rsi, round(1 - rsi / 100, 6) AS contrarian,
         round(greatest(0.0, least(1.0, bb_position)), 6) + 0.0 AS band
  FROM prep)"""


def predictions_sql() -> str:
    return f"""{wide_predictions_sql()},
predictions AS (
  SELECT series_id, ts, y, model, score, CAST(score > 0.5 AS INTEGER) AS pred
  FROM (UNPIVOT scored ON rsi, contrarian, band INTO NAME model VALUE score))"""


def metrics_sql(by: str = "model", source: str = "predictions") -> str:
    """confusion and metrics (one row for each ``by``) over predictions."""
    return f"""
confusion AS (
  SELECT {by}, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp
  FROM {source} GROUP BY {by}),
ranked AS (
  SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY score) AS rk,
         count(*) OVER (PARTITION BY {by}, score) AS ties FROM {source}),
auc AS (
  SELECT {by}, (sum(CASE WHEN y = 1 THEN rk + (ties - 1) / 2.0::DOUBLE END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
         / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE AS roc_auc
  FROM ranked GROUP BY {by}),
metrics AS (
  SELECT c.*, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0) AS accuracy,
         coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision",
         coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, roc_auc
  FROM confusion c JOIN auc USING ({by}))"""


# -- drift pair -----------------------------------------------------------------

DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "discount_pct", "tax_pct"]
CUT = "2000-06-01 00:00:00"


def drift_pair(spark: SparkSession, d: str, shifted: bool = False) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")

    def side(rows: DataFrame, factor: float, plus: float) -> DataFrame:
        return rows.select(
            (F.col("l_quantity") * factor).alias("l_quantity"),
            (F.col("l_extendedprice") + plus).alias("l_extendedprice"),
            F.round(F.col("l_discount") * 100).alias("discount_pct"),
            F.round(F.col("l_tax") * 100).alias("tax_pct"),
        )

    reference = side(items.where(F.col("l_shipdate") < cut), 1.0, 0.0)
    later = items.where(F.col("l_shipdate") >= cut)
    return reference, side(later, 1.5, 20000.0) if shifted else side(later, 1.0, 0.0)


def drift_sql(shifted: bool = False) -> str:
    """long(is_ref, feature, value) of both sides."""
    quantity, price = ("l_quantity * 1.5::DOUBLE", "l_extendedprice + 20000.0::DOUBLE") if shifted else (
        "l_quantity",
        "l_extendedprice",
    )
    return f"""
sides AS (
  SELECT true AS is_ref, l_quantity, l_extendedprice, round(l_discount * 100) + 0.0 AS discount_pct,
         round(l_tax * 100) + 0.0 AS tax_pct
  FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'
  UNION ALL
  SELECT false, {quantity}, {price}, round(l_discount * 100) + 0.0, round(l_tax * 100) + 0.0
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'),
long AS (
  SELECT is_ref, feature, value
  FROM (UNPIVOT sides ON {', '.join(DRIFT_FEATURES)} INTO NAME feature VALUE value)),
stats AS (
  SELECT feature, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur,
         avg(value) FILTER (WHERE is_ref) AS m_ref, avg(value) FILTER (WHERE NOT is_ref) AS m_cur,
         stddev_samp(value) FILTER (WHERE is_ref) AS s_ref, stddev_samp(value) FILTER (WHERE NOT is_ref) AS s_cur,
         var_samp(value) FILTER (WHERE is_ref) AS v_ref, var_samp(value) FILTER (WHERE NOT is_ref) AS v_cur,
         min(value) FILTER (WHERE is_ref) AS lo_ref, max(value) FILTER (WHERE is_ref) AS hi_ref,
         min(value) AS lo_all, max(value) AS hi_all
  FROM long GROUP BY feature)"""


def ks_sql(standardize: bool, name: str = "ks") -> str:
    value = (
        "CASE WHEN is_ref THEN (value - m_ref) / nullif(s_ref, 0) ELSE (value - m_cur) / nullif(s_cur, 0) END"
        if standardize
        else "value"
    )
    return f"""
{name}_pts AS (
  SELECT feature, {value} AS v, count(*) FILTER (WHERE is_ref) AS a, count(*) FILTER (WHERE NOT is_ref) AS b
  FROM long JOIN stats USING (feature) GROUP BY 1, 2),
{name}_cum AS (
  SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY v)::DOUBLE AS a,
         sum(b) OVER (PARTITION BY feature ORDER BY v)::DOUBLE AS b FROM {name}_pts),
{name}_d AS (
  SELECT feature, n_ref, n_cur, max(abs(a / n_ref - b / n_cur)) AS statistic
  FROM {name}_cum JOIN stats USING (feature) GROUP BY feature, n_ref, n_cur),
{name} AS (
  SELECT *, {ks_p_sql('statistic', 'n_ref', 'n_cur')} AS p_value FROM {name}_d)"""


def ks_p_sql(d: str, n: str, m: str) -> str:
    e = f"sqrt({n}::DOUBLE * {m}::DOUBLE / ({n}::DOUBLE + {m}::DOUBLE))"
    lam = f"(({e} + 0.12 + 0.11 / {e}) * {d})"
    return (
        f"CASE WHEN {lam} < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
        f" * exp(-2.0 * {lam} * {lam} * k * k) for k in range(1, 101)]))) END"
    )


def psi_sql(span: str, name: str = "psi") -> str:
    lo, hi = ("lo_all", "hi_all") if span == "combined" else ("lo_ref", "hi_ref")
    return f"""
{name}_edges AS (
  SELECT feature, CASE WHEN {lo} = {hi} THEN {lo} - 0.5 ELSE {lo} END AS lo,
         CASE WHEN {lo} = {hi} THEN {hi} + 0.5 ELSE {hi} END AS hi FROM stats),
{name}_bins AS (
  SELECT is_ref, feature, list_sum([CASE WHEN value >= lo + (hi - lo) * i::DOUBLE / 10.0::DOUBLE THEN 1 ELSE 0 END
                                   for i in range(1, 10)]) AS bin
  FROM long JOIN {name}_edges USING (feature) WHERE value BETWEEN lo AND hi),
{name}_grid AS (SELECT feature, unnest(range(0, 10)) AS bin FROM stats),
{name}_counts AS (
  SELECT g.feature, g.bin, count(*) FILTER (WHERE b.is_ref) AS a, count(*) FILTER (WHERE NOT b.is_ref) AS b
  FROM {name}_grid g LEFT JOIN {name}_bins b ON g.feature = b.feature AND g.bin = b.bin GROUP BY 1, 2),
{name}_shares AS (
  SELECT feature, a / nullif(sum(a) OVER (PARTITION BY feature), 0)::DOUBLE AS ra,
         b / nullif(sum(b) OVER (PARTITION BY feature), 0)::DOUBLE AS rb FROM {name}_counts),
{name}_fixed AS (
  SELECT feature, CASE WHEN ra = 0 THEN 0.0001::DOUBLE ELSE ra END AS ra,
         CASE WHEN rb = 0 THEN 0.0001::DOUBLE ELSE rb END AS rb FROM {name}_shares),
{name} AS (SELECT feature, sum((rb - ra) * ln(rb / ra)) AS psi FROM {name}_fixed GROUP BY feature)"""


PSI_LABEL_SQL = (
    "CASE WHEN psi < 0.05 THEN 'none' WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"
)


def welch_sql() -> str:
    """welch(feature, statistic, df, p_value): p by Simpson's rule on the density."""
    return """
welch_t AS (
  SELECT feature, (m_ref - m_cur) / sqrt(v_ref / n_ref + v_cur / n_cur) AS statistic,
         power(v_ref / n_ref + v_cur / n_cur, 2)
           / (power(v_ref / n_ref, 2) / (n_ref - 1) + power(v_cur / n_cur, 2) / (n_cur - 1)) AS df
  FROM stats),
welch AS (
  SELECT feature, statistic, df,
    CASE WHEN abs(statistic) > 40 THEN 0.0::DOUBLE ELSE
      1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs(statistic) / 6000
        * list_sum([(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
            * power(1 + power(abs(statistic) * i / 2000.0::DOUBLE, 2) / df, -(df + 1) / 2)
            for i in range(0, 2001)]) END AS p_value
  FROM welch_t)"""


