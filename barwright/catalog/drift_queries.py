"""Drift: profiles of both sides, the three methods, combined and weekly runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.catalog.inputs import (
    DRIFT_FEATURES,
    PSI_LABEL_SQL,
    Registry,
    drift_pair,
    drift_sql,
    ks_p_sql,
    ks_sql,
    psi_sql,
    r,
    rounded,
    rs,
    table,
    welch_sql,
)
from barwright.functions.pvalues import ks_p_value
from barwright.functions.rules import drift_action, drift_severity, psi_label
from barwright.operators import drift
from barwright.plans.monitoring import drift_check, weekly_drift

REGISTRY = Registry()
query = REGISTRY.query

ACTION_SQL = "CASE WHEN {n} = 0 THEN 'none' WHEN {n} <= 3 THEN 'monitor' ELSE 'retrain' END"
SEVERITY_SQL = "CASE WHEN {n} = 0 THEN 'none' WHEN {n} <= 2 THEN 'moderate' ELSE 'significant' END"


@query(
    "a07_reference_stats",
    f"""WITH {drift_sql()}
SELECT feature, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
       {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.75)', 'q3')}
FROM long WHERE is_ref GROUP BY feature""",
)
def _(spark, d):
    reference, _ = drift_pair(spark, d)
    return rounded(drift.reference_stats(reference, DRIFT_FEATURES))


@query(
    "a18_overlay_histogram",
    f"""WITH {drift_sql(True)},{psi_sql('combined')}
SELECT CASE WHEN is_ref THEN 'reference' ELSE 'current' END AS side, feature, bin::INTEGER AS bin, count(*) AS n,
       {r('any_value(CASE WHEN is_ref THEN m_ref ELSE m_cur END)', 'mean')}, {r('any_value(CASE WHEN is_ref THEN s_ref ELSE s_cur END)', 'std')}
FROM psi_bins JOIN stats USING (feature) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return rounded(drift.overlay_histogram(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES))


@query(
    "a19_moment_change",
    f"WITH {drift_sql(True)} SELECT {r('avg(m_cur - m_ref)', 'mean_change')}, {r('avg(s_cur - s_ref)', 'std_change')} FROM stats",
)
def _(spark, d):
    return rounded(drift.moment_change(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES))


@query(
    "p05_common_numeric_columns",
    f"""WITH {drift_sql()}
SELECT feature, n_ref, n_cur FROM stats""",
)
def _(spark, d):
    """The current table also has a text column and lacks none; counts show what is compared."""
    reference, current = drift_pair(spark, d)
    current = current.withColumn("note", F.lit("x"))
    features = drift.common_numeric_columns(reference.withColumn("note", F.lit("y")), current)
    pair = drift.paired_moments(reference, current, features)
    return pair.select("feature", F.col("ref_n").alias("n_ref"), F.col("cur_n").alias("n_cur"))


@query(
    "u03_column_intersection",
    """SELECT 'l_orderkey' AS feature, count(l_orderkey) AS n_ref, (SELECT count(o_orderkey) FROM orders) AS n_cur FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), (SELECT count(o_totalprice) FROM orders) FROM lineitem""",
)
def _(spark, d):
    """Two tables with different column sets; only shared double/long columns remain."""
    items = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_totalprice").alias("l_extendedprice"),
        F.col("o_orderstatus").alias("l_returnflag"),
        "o_orderpriority",
    )
    features = drift.common_numeric_columns(items, orders)
    pair = drift.paired_moments(items, orders, features)
    return pair.select("feature", F.col("ref_n").alias("n_ref"), F.col("cur_n").alias("n_cur"))


@query(
    "p06_skip_missing_features",
    f"WITH {drift_sql()} SELECT feature, n_ref, feature <> 'tax_pct' AS is_compared FROM stats",
)
def _(spark, d):
    reference, current = drift_pair(spark, d)
    _, skipped = drift.usable_features(current.drop("tax_pct"), DRIFT_FEATURES)
    m = drift.moments(reference, DRIFT_FEATURES)
    return m.select("feature", F.col("n").alias("n_ref"), (~F.col("feature").isin(*skipped)).alias("is_compared"))


@query(
    "p07_minimum_rows",
    """SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-08') AS n_ref, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-08') AS n_cur
FROM events GROUP BY 1 HAVING n_ref >= 10 AND n_cur >= 10""",
)
def _(spark, d):
    early = F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")
    counts = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(early).alias("n_ref"), F.count_if(~early).alias("n_cur")
    )
    return drift.enough_rows(counts)


# -- Kolmogorov-Smirnov ----------------------------------------------------------


@query("d01_ks_standardised", f"WITH {drift_sql(True)},{ks_sql(True)} SELECT feature, {r('statistic')}, n_ref, n_cur FROM ks")
def _(spark, d):
    out = drift.ks_statistic(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES, standardize=True)
    return rounded(out.select("feature", "statistic", "n_ref", "n_cur"))


@query("d02_ks_raw", f"WITH {drift_sql(True)},{ks_sql(False)} SELECT feature, {r('statistic')}, n_ref, n_cur FROM ks")
def _(spark, d):
    out = drift.ks_statistic(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES, standardize=False)
    return rounded(out.select("feature", "statistic", "n_ref", "n_cur"))


@query("d03_ks_p_value", f"WITH {drift_sql()},{ks_sql(False)} SELECT feature, {rs('statistic', 'p_value')}, p_value < 0.05 AS is_drift FROM ks")
def _(spark, d):
    out = drift.ks_drift(*drift_pair(spark, d), DRIFT_FEATURES, standardize=False)
    return rounded(out.select("feature", "statistic", "p_value", "is_drift"))


@query(
    "d03_ks_p_value_grid",
    f"""SELECT l_linenumber, l_returnflag, count(*) AS n, {r(ks_p_sql('0.05::DOUBLE', 'count(*)', '(count(*) + 50)'), 'p_value')}
FROM lineitem GROUP BY 1, 2""",
)
def _(spark, d):
    """The p-value of one distance over many sample sizes."""
    n = F.count(F.lit(1))
    g = table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(n.alias("n"))
    return rounded(g.withColumn("p_value", ks_p_value(F.lit(0.05), F.col("n"), F.col("n") + 50)))


# -- population stability --------------------------------------------------------


@query(
    "d04_psi_combined_range",
    f"WITH {drift_sql(True)},{psi_sql('combined')} SELECT feature, {r('psi')}, psi > 0.1 AS is_drift, {PSI_LABEL_SQL} AS interpretation FROM psi",
)
def _(spark, d):
    out = drift.psi_drift(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES)
    return rounded(out.select("feature", "psi", "is_drift", "interpretation"))


@query(
    "d05_psi_reference_range",
    f"WITH {drift_sql(True)},{psi_sql('reference')} SELECT feature, {r('coalesce(psi, 0)', 'psi')} FROM psi",
)
def _(spark, d):
    out = drift.psi(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES, span="reference")
    return rounded(out.select("feature", "psi"))


@query(
    "f06_psi_label",
    f"SELECT l_orderkey, l_linenumber, {PSI_LABEL_SQL.replace('psi', '(l_discount * 3)')} AS label FROM lineitem",
)
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", psi_label(F.col("l_discount") * 3).alias("label"))


# -- Welch ------------------------------------------------------------------------


@query("d06_welch_statistic", f"WITH {drift_sql(True)},{welch_sql()} SELECT feature, {r('statistic')}, {r('df', digits=3)} FROM welch_t")
def _(spark, d):
    out = drift.welch(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES)
    return rounded(out.select("feature", "statistic", F.round("df", 3).alias("df")))


@query("d07_welch_p_value", f"WITH {drift_sql()},{welch_sql()} SELECT feature, {rs('statistic', 'p_value')}, p_value < 0.05 AS is_drift FROM welch")
def _(spark, d):
    out = drift.welch_drift(*drift_pair(spark, d), DRIFT_FEATURES)
    return rounded(out.select("feature", "statistic", "p_value", "is_drift"))


# -- combined -----------------------------------------------------------------------


def _results_sql(shifted=True, limits=(0.05, 0.1, 0.05)):
    ks_limit, psi_limit, t_limit = limits
    return f"""{drift_sql(shifted)},{ks_sql(True)},{psi_sql('combined')},{welch_sql()},
results AS (
  SELECT 'ks' AS method, feature, statistic, p_value, NULL::DOUBLE AS psi, p_value < {ks_limit} AS is_drift, {ks_limit}::DOUBLE AS threshold, NULL::VARCHAR AS interpretation FROM ks
  UNION ALL SELECT 'psi', feature, NULL, NULL, psi, psi > {psi_limit}, {psi_limit}, {PSI_LABEL_SQL} FROM psi
  UNION ALL SELECT 'ttest', feature, statistic, p_value, NULL, p_value < {t_limit}, {t_limit}, NULL FROM welch),
votes AS (SELECT feature, count(*) FILTER (WHERE is_drift) AS n_votes FROM results GROUP BY feature)"""


_result_cols = f"method, feature, {r('statistic')}, {r('p_value')}, {r('psi')}, is_drift, threshold, interpretation"


@query("d08_all_methods", f"WITH {_results_sql()} SELECT {_result_cols} FROM results")
def _(spark, d):
    results, _ = drift_check(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES)
    return rounded(results)


@query("d08_two_methods", f"WITH {_results_sql(False)} SELECT {_result_cols} FROM results WHERE method <> 'ttest'")
def _(spark, d):
    return rounded(drift.detect_drift(*drift_pair(spark, d), DRIFT_FEATURES, methods=["ks", "psi"]))


_summary = f"""
SELECT count(*) FILTER (WHERE n_votes > 0) AS total_drifted_features,
       array_to_string(list_sort(list(feature) FILTER (WHERE n_votes > 0)), ',') AS drifted_features,
       coalesce(array_to_string(list_sort(list(feature || '=' || n_votes) FILTER (WHERE n_votes > 1)), ','), '') AS consensus,
       count(*) FILTER (WHERE n_votes > 0) > 0 AS overall_drift_detected,
       {ACTION_SQL.format(n='count(*) FILTER (WHERE n_votes > 0)')} AS recommended_action
FROM votes"""


@query("d09_summary", f"WITH {_results_sql()} {_summary}")
def _(spark, d):
    _, summary = drift_check(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES)
    pairs = F.transform(
        F.array_sort(F.map_entries("feature_drift_consensus")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return summary.select(
        "total_drifted_features",
        F.array_join("drifted_features", ",").alias("drifted_features"),
        F.array_join(pairs, ",").alias("consensus"),
        "overall_drift_detected",
        "recommended_action",
    )


@query("u02_drift_votes", f"WITH {_results_sql()} SELECT feature, n_votes FROM votes WHERE n_votes > 0")
def _(spark, d):
    return drift.drift_votes(drift.detect_drift(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES))


_board_sql = f"""{drift_sql(True)},{ks_sql(False)},{psi_sql('reference')},
board AS (
  SELECT feature, coalesce(psi, 0) AS psi, p_value AS ks_p_value, p_value < 0.05 OR coalesce(psi, 0) > 0.1 AS is_drift
  FROM ks JOIN psi USING (feature) WHERE n_ref >= 10 AND n_cur >= 10)"""


@query("d10_dashboard_rule", f"WITH {_board_sql} SELECT feature, {rs('psi', 'ks_p_value')}, is_drift FROM board")
def _(spark, d):
    return rounded(drift.dashboard_drift(*drift_pair(spark, d, shifted=True)))


@query(
    "f14_dashboard_severity",
    f"WITH {_board_sql} SELECT count(*) AS n_features, count(*) FILTER (WHERE is_drift) AS n_drifted, {SEVERITY_SQL.format(n='count(*) FILTER (WHERE is_drift)')} AS severity FROM board",
)
def _(spark, d):
    return drift.dashboard_summary(drift.dashboard_drift(*drift_pair(spark, d, shifted=True)))


_f13_groups = "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1"


@query(
    "f13_drift_action",
    f"SELECT l_suppkey, n, {ACTION_SQL.format(n='n')} AS action, {SEVERITY_SQL.format(n='n')} AS severity FROM ({_f13_groups})",
)
def _(spark, d):
    """Both count rules over a count that takes many values."""
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    return n.select("l_suppkey", "n", drift_action(F.col("n")).alias("action"), drift_severity(F.col("n")).alias("severity"))


_weekly = f"""
weeks AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, value FROM events WHERE ts >= TIMESTAMP '2024-01-08'),
ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-08'),
long AS (
  SELECT week AS feature, true AS is_ref, ref.value FROM (SELECT DISTINCT week FROM weeks), ref
  UNION ALL SELECT week, false, value FROM weeks),
stats AS (
  SELECT feature, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur,
         avg(value) FILTER (WHERE is_ref) AS m_ref, avg(value) FILTER (WHERE NOT is_ref) AS m_cur,
         stddev_samp(value) FILTER (WHERE is_ref) AS s_ref, stddev_samp(value) FILTER (WHERE NOT is_ref) AS s_cur,
         var_samp(value) FILTER (WHERE is_ref) AS v_ref, var_samp(value) FILTER (WHERE NOT is_ref) AS v_cur,
         min(value) FILTER (WHERE is_ref) AS lo_ref, max(value) FILTER (WHERE is_ref) AS hi_ref,
         min(value) AS lo_all, max(value) AS hi_all
  FROM long GROUP BY feature)"""


@query(
    "d11_weekly_check",
    f"""WITH {_weekly},{ks_sql(True)},{psi_sql('combined')},{welch_sql()}
SELECT feature AS week, 'ks' AS method, {r('statistic')}, {r('p_value')}, NULL::DOUBLE AS psi, p_value < 0.05 AS is_drift FROM ks
UNION ALL SELECT feature, 'psi', NULL, NULL, {r('psi').split(' AS ')[0]}, psi > 0.1 FROM psi
UNION ALL SELECT feature, 'ttest', {r('statistic').split(' AS ')[0]}, {r('p_value').split(' AS ')[0]}, NULL, p_value < 0.05 FROM welch""",
)
def _(spark, d):
    e = table(spark, d, "events").select("ts", "value")
    cut = F.lit("2024-01-08").cast("timestamp_ntz")
    out = weekly_drift(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["value"])
    return rounded(out.select("week", "method", "statistic", "p_value", "psi", "is_drift"))


def _preset_sql():
    presets = {"strict": (0.01, 0.05, 0.01), "moderate": (0.05, 0.10, 0.05), "loose": (0.10, 0.25, 0.10)}
    rows = ", ".join(
        f"('{n}', '{m}', {v}::DOUBLE)" for n, t in presets.items() for m, v in zip(("ks", "psi", "ttest"), t)
    )
    return f"""WITH {_results_sql()},
presets(preset, method, threshold) AS (VALUES {rows})
SELECT preset, method, feature, p.threshold, CASE WHEN method = 'psi' THEN psi > p.threshold ELSE p_value < p.threshold END AS is_drift
FROM results JOIN presets p USING (method)"""


@query("d12_threshold_presets", _preset_sql())
def _(spark, d):
    results, _ = drift_check(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES)
    return drift.judge_presets(results).select("preset", "method", "feature", "threshold", "is_drift")


@query(
    "d13_report",
    f"""WITH {_results_sql()}
SELECT method, count(*) AS n_features, count(*) FILTER (WHERE is_drift) AS n_drifted,
       coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE is_drift)), ','), '') AS drifted FROM results GROUP BY method""",
)
def _(spark, d):
    report = drift.drift_report(drift.detect_drift(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES))
    return report.select("method", "n_features", "n_drifted", F.array_join("drifted.feature", ",").alias("drifted"))


@query(
    "d14_monitoring_record",
    f"""WITH {drift_sql(True)},{psi_sql('combined')}, n AS (SELECT count(*) FILTER (WHERE psi > 0.1) AS k FROM psi)
SELECT 'psi' AS detection_method, k AS n_drifted, {SEVERITY_SQL.format(n='k')} AS drift_severity, {ACTION_SQL.format(n='k')} AS recommended_action,
       k > 0 AS should_retrain, {r('(SELECT sum(psi) FROM psi)', 'psi_total')} FROM n""",
)
def _(spark, d):
    results = drift.detect_drift(*drift_pair(spark, d, shifted=True), DRIFT_FEATURES, ["psi"])
    record = drift.monitoring_record(results)
    total = F.aggregate(F.map_values("psi_scores"), F.lit(0.0), lambda a, x: a + x)
    return rounded(
        record.select(
            "detection_method", "n_drifted", "drift_severity", "recommended_action", "should_retrain", total.alias("psi_total")
        )
    )
