"""Drift methods against brute force on small tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions.pvalues import ks_p_value_exact, ks_p_value, welch_p_value
from barwright.operators import drift
from barwright.operators.ordered import approximate_quantiles, exact_quantiles
from barwright.session import materialize


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(3)
    ref = pd.DataFrame({"a": rng.normal(0, 1, 900), "b": rng.integers(0, 6, 900).astype(float), "c": 1.0})
    cur = pd.DataFrame({"a": rng.exponential(1, 400), "b": rng.integers(2, 9, 400).astype(float), "c": 1.0})
    cur["g"] = ["x", "y", "z", "z"] * 100
    ref.loc[::7, "a"] = np.nan
    cur.loc[::5, "b"] = np.nan

    # Missing values stay NaN on one side and become NULL on the other.
    cur_df = spark.createDataFrame(cur).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    return ref, cur, spark.createDataFrame(ref), cur_df


def ks(x, y):
    points = np.union1d(x, y)
    fx = np.searchsorted(np.sort(x), points, side="right") / len(x)
    fy = np.searchsorted(np.sort(y), points, side="right") / len(y)
    return np.abs(fx - fy).max()


def psi(x, y, edges):
    p, q = np.histogram(x, edges)[0], np.histogram(y, edges)[0]
    p, q = p / p.sum(), q / q.sum()
    p, q = np.where(p == 0, 0.0001, p), np.where(q == 0, 0.0001, q)
    return ((q - p) * np.log(q / p)).sum()


def scaled(x):
    return (x - x.mean()) / x.std(ddof=1)


def test_ks_raw_and_standardised(pair, many_partitions):
    ref, cur, r, c = pair
    for standardize in (False, True):
        got = drift.ks_statistic(r, c, ["a", "b"], standardize).toPandas().set_index("feature")["statistic"]
        for f in ("a", "b"):
            x, y = ref[f].dropna().to_numpy(), cur[f].dropna().to_numpy()
            want = ks(scaled(x), scaled(y)) if standardize else ks(x, y)
            assert got[f] == pytest.approx(want, abs=1e-12)


def test_constant_feature_has_no_standardised_distance(pair):
    _, _, r, c = pair
    got = drift.ks_drift(r, c, ["c"]).collect()[0]
    assert got["statistic"] is None and got["is_drift"] is False


def test_groups_equal_separate_runs(pair, many_partitions):
    ref, cur, r, c = pair
    got = drift.ks_statistic(r, c, ["a", "b"], False, by="g").toPandas().set_index(["grp", "feature"])["statistic"]
    index = drift.psi(r, c, ["a", "b"], by="g").toPandas().set_index(["grp", "feature"])["psi"]
    t = drift.welch(r, c, ["a", "b"], by="g").toPandas().set_index(["grp", "feature"])
    for g in "xyz":
        for f in ("a", "b"):
            x, y = ref[f].dropna().to_numpy(), cur.loc[cur.g == g, f].dropna().to_numpy()
            assert got[g, f] == pytest.approx(ks(x, y), abs=1e-12)
            both = np.concatenate([x, y])
            edges = np.linspace(both.min(), both.max(), 11)
            assert index[g, f] == pytest.approx(psi(x, y, edges), abs=1e-9)
            se = x.var(ddof=1) / len(x) + y.var(ddof=1) / len(y)
            assert t.loc[(g, f), "statistic"] == pytest.approx((x.mean() - y.mean()) / se**0.5)


def test_psi_spans(pair):
    ref, cur, r, c = pair
    for span in ("combined", "reference"):
        got = drift.psi(r, c, ["a", "b"], span).toPandas().set_index("feature")["psi"]
        for f in ("a", "b"):
            x, y = ref[f].dropna().to_numpy(), cur[f].dropna().to_numpy()
            both = np.concatenate([x, y]) if span == "combined" else x
            assert got[f] == pytest.approx(psi(x, y, np.linspace(both.min(), both.max(), 11)), abs=1e-9)


def test_equal_constants_have_zero_psi(pair):
    _, _, r, c = pair
    row = drift.psi_drift(r, c, ["c"]).collect()[0]
    assert row["psi"] == 0 and row["interpretation"] == "none" and row["is_drift"] is False


def test_no_current_value_in_reference_range(spark):
    r = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    c = r.select((F.col("v") + 1000).alias("v"))
    assert drift.psi(r, c, ["v"], "reference").collect()[0]["psi"] == 0.0


def test_last_bin_is_closed_and_flat_range_widens(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(11)], "v double, flat double")
    got = drift.histogram(df, ["v", "flat"]).toPandas()
    v = got[got.feature == "v"].sort_values("bin")
    assert v["n"].tolist() == [1] * 9 + [2]
    flat = got[got.feature == "flat"].sort_values("bin")
    assert flat["left_edge"].iloc[0] == 6.5 and flat["right_edge"].iloc[-1] == 7.5 and flat["n"].sum() == 11


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"u": rng.random(3001), "tied": rng.integers(0, 3, 3001) * 1.0, "long": np.exp(rng.normal(0, 9, 3001))})
    df = spark.createDataFrame(pdf)
    for accuracy in (10000, 200):
        got = exact_quantiles(df, list(pdf), (0.0, 0.25, 0.5, 0.9, 1.0), accuracy).toPandas().set_index("feature")
        for f in pdf:
            want = np.quantile(pdf[f], [0.0, 0.25, 0.5, 0.9, 1.0])
            np.testing.assert_allclose(got.loc[f, [f"q{i}" for i in range(5)]].astype(float), want, rtol=1e-12)
    near = approximate_quantiles(df, ["u"]).collect()[0]
    assert near["n"] == 3001 and abs(near["q1"] - 0.5) < 0.05


def test_quantiles_of_one_and_no_value(spark):
    df = spark.createDataFrame([(4.0, None)], "a double, b double")
    got = {row["feature"]: row for row in exact_quantiles(df, ["a", "b"]).collect()}
    assert got["a"]["q1"] == 4.0 and got["b"]["q1"] is None and got["b"]["n"] == 0


def test_p_values(spark):
    # Textbook quantiles of Student's t and of the Kolmogorov distribution.
    t_rows = [(2.228139, 10.0, 0.05), (12.7062, 1.0, 0.05), (1.959964, 1e9, 0.05), (2.575829, 2e7, 0.01), (0.0, 5.0, 1.0), (-2.0, 60.0, 0.05003)]
    df = spark.createDataFrame(t_rows, "t double, df double, p double")
    for row in df.select("p", welch_p_value(F.col("t"), F.col("df")).alias("q")).collect():
        assert row["q"] == pytest.approx(row["p"], abs=2e-5)
    n = 10**6
    d = 1.3581 / (n / 2) ** 0.5
    row = spark.range(1).select(
        ks_p_value(F.lit(d), F.lit(n), F.lit(n)).alias("p"), ks_p_value(F.lit(0.0), F.lit(50), F.lit(50)).alias("one")
    ).collect()[0]
    assert row["p"] == pytest.approx(0.05, abs=2e-4) and row["one"] == 1.0


def test_identical_tables_do_not_drift(pair):
    _, _, r, _ = pair
    results = drift.detect_drift(r, r, ["a", "b"])
    summary = drift.drift_summary(results).collect()[0]
    assert summary["total_drifted_features"] == 0 and summary["recommended_action"] == "none"
    assert summary["drifted_features"] == [] and summary["feature_drift_consensus"] == {}


def test_summary_counts_votes(spark):
    rows = [("ks", "a", True), ("psi", "a", True), ("ttest", "a", False), ("ks", "b", False), ("psi", "b", True)]
    rows += [("ks", c, True) for c in "cd"]
    s = drift.drift_summary(spark.createDataFrame(rows, "method string, feature string, is_drift boolean")).collect()[0]
    assert s["drifted_features"] == ["a", "b", "c", "d"]
    assert s["feature_drift_consensus"] == {"a": 2} and s["recommended_action"] == "retrain"


def test_unknown_method_and_missing_feature(pair):
    _, _, r, c = pair
    with pytest.raises(ValueError):
        drift.detect_drift(r, c, ["a"], methods=["nope"])
    got = drift.detect_drift(r, c.drop("b"), ["a", "b"], methods=["psi"]).collect()
    assert [row["feature"] for row in got if row["method"] != "skipped"] == ["a"]


def test_summaries_keep_groups_apart(spark):
    rows = [("w1", "ks", "f", True), ("w2", "ks", "f", True), ("w2", "psi", "f", True), ("w3", "ks", "f", False)]
    results = spark.createDataFrame(rows, "grp string, method string, feature string, is_drift boolean")
    got = {r["grp"]: r for r in drift.drift_summary(results, ["grp"]).collect()}
    assert got["w1"]["feature_drift_consensus"] == {} and got["w2"]["feature_drift_consensus"] == {"f": 2}
    assert not got["w3"]["overall_drift_detected"]
    assert {(r["grp"], r["n_votes"]) for r in drift.drift_votes(results, ["grp"]).collect()} == {("w1", 1), ("w2", 2)}


def test_default_features_and_skipped_ones(spark):
    a = spark.createDataFrame([(float(i), str(i), float(i)) for i in range(50)], "x double, t string, gone double")
    b = spark.createDataFrame([(float(i) + 100, str(i), "text") for i in range(50)], "x double, t string, gone string")
    assert {r["feature"] for r in drift.detect_drift(a, b).collect()} == {"x"}
    found = drift.detect_drift(a, b.drop("gone"), ["x", "gone"], methods=["psi"]).collect()
    assert {(r["method"], r["feature"], r["is_drift"]) for r in found} == {("psi", "x", True), ("skipped", "gone", False)}


def test_quantiles_by_nested_brackets(spark):
    """Brackets that hold too much are cut again, also where most values are copies of a few."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(
        {
            "u": rng.random(20_000),
            "heavy": np.where(rng.random(20_000) < 0.9, 5.0, rng.normal(5, 1, 20_000)),
            "edge": np.where(rng.random(20_000) < 0.5, 1.0, 2.0),
            "wide": np.exp(rng.normal(0, 60, 20_000)),
        }
    )
    df = materialize(spark.createDataFrame(pdf))
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.77777, 0.95, 1.0)
    got = exact_quantiles(df, list(pdf), probabilities, accuracy=100, most=16).toPandas().set_index("feature")
    for f in pdf:
        np.testing.assert_allclose(got.loc[f, [f"q{i}" for i in range(7)]].astype(float), np.quantile(pdf[f], probabilities), rtol=1e-12)
    plan = exact_quantiles(df, ["u"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_exact_ks_p_values(spark):
    """Against all orders of the pooled sample, and published tail values of equal samples."""
    import itertools

    rows, want = [], []
    for n, m in [(1, 1), (2, 3), (4, 4), (3, 7), (5, 6)]:
        gaps = []
        for picks in itertools.combinations(range(n + m), n):
            steps = np.full(n + m, -1.0 / m)
            steps[list(picks)] = 1.0 / n
            gaps.append(np.abs(np.cumsum(steps)).max())
        for d in sorted({round(g, 9) for g in gaps}):
            rows.append((float(d), n, m))
            want.append(np.mean(np.array(gaps) >= d - 1e-9))
    for n in (10, 20, 100):  # samples of one size have a closed form
        for k in range(1, n + 1, 3):
            terms = [(-1) ** (j - 1) * math.comb(2 * n, n - j * k) / math.comb(2 * n, n) for j in range(1, n // k + 1)]
            rows.append((k / n, n, n))
            want.append(min(1.0, 2 * sum(terms)))
    df = spark.createDataFrame(rows, "d double, n int, m int")
    got = [r["p"] for r in df.select("d", "n", "m", ks_p_value_exact(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    np.testing.assert_allclose(got, want, rtol=1e-7)


def test_small_samples_use_the_exact_p_value(spark):
    r = spark.createDataFrame([(float(i),) for i in range(12)], "v double")
    c = spark.createDataFrame([(float(i * i),) for i in range(15)], "v double")
    exact = drift.ks_drift(r, c, ["v"], standardize=False).collect()[0]
    rough = drift.ks_drift(r, c, ["v"], standardize=False, exact_up_to=0).collect()[0]
    assert exact["statistic"] == rough["statistic"] and exact["p_value"] != rough["p_value"]
    assert abs(exact["p_value"] - rough["p_value"]) < 0.1


def test_psi_of_many_groups(spark, many_partitions):
    """Each group's own bins, against a plain count, with values that equal cuts; no row holds all cuts."""
    rng = np.random.default_rng(7)
    ref = rng.integers(0, 40, 800) / 4.0
    cur = pd.DataFrame({"g": [f"g{i % 60}" for i in range(1800)], "v": rng.integers(-8, 60, 1800) / 4.0})
    got = drift.psi(spark.createDataFrame(pd.DataFrame({"v": ref})), spark.createDataFrame(cur), ["v"], by="g").collect()
    assert len(got) == 60
    for row in got:
        own = cur.loc[cur.g == row["grp"], "v"].to_numpy()
        low, high = min(ref.min(), own.min()), max(ref.max(), own.max())
        edges = [low + (high - low) * i / 10.0 for i in range(1, 10)]
        shares = [np.bincount(np.searchsorted(edges, x, side="right"), minlength=10) / len(x) for x in (ref, own)]
        a, b = (np.where(x == 0, 0.0001, x) for x in shares)
        assert row["psi"] == pytest.approx(((b - a) * np.log(b / a)).sum(), rel=1e-9)
