"""Metrics against brute force, gates and threshold rules at their limits."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwright.functions import rules
from barwright.operators import metrics as met
from barwright.operators import prepare as prep
from barwright.operators import scoring
from barwright.operators.ordered import RANGE, range_parts

SCHEMA = "model string, y int, score double, pred int"


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    if not pos or not neg:
        return None
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 10)), min_size=1, max_size=60))
def test_auc_with_ties(spark, rows):
    data = [("m", y, s / 10.0, int(s > 5)) for y, s in rows]
    got = met.evaluate(spark.createDataFrame(data, SCHEMA)).collect()[0]
    want = brute_auc([y for y, _ in rows], [s for _, s in rows])
    assert got["roc_auc"] == (None if want is None else pytest.approx(want))
    assert got["tn"] + got["fp"] + got["fn"] + got["tp"] == len(rows)
    assert got["accuracy"] == pytest.approx(np.mean([y == int(s > 5) for y, s in rows]))


def test_many_parts_chain(spark, many_partitions):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 4000)
    s = np.round(rng.normal(y * 0.4, 1.0), 3)
    data = [(m, int(a), float(b if m == "m" else -b), int(b > 0)) for a, b in zip(y, s) for m in ("m", "n")]
    df = spark.createDataFrame(data, SCHEMA)
    assert range_parts(df, ["model"], "score").select(RANGE).distinct().count() > 4
    got = {r["model"]: r["roc_auc"] for r in met.roc_auc(df).collect()}
    ranks = np.argsort(np.argsort(s, kind="stable"))
    assert got["m"] + got["n"] == pytest.approx(1.0)
    rough = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert got["m"] == pytest.approx(rough, abs=1e-3)


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([("m", 1, 0.1, 0), ("m", 0, 0.2, 0)], SCHEMA)
    got = met.evaluate(df).collect()[0]
    assert (got["precision"], got["recall"], got["f1"]) == (0.0, 0.0, 0.0)


def test_classification_report_support(spark):
    df = spark.createDataFrame([("m", 1, 0.9, 1), ("m", 1, 0.2, 0), ("m", 0, 0.2, 0), ("m", 0, 0.7, 1), ("m", 0, 0.1, 0)], SCHEMA)
    got = {r["label"]: r for r in met.classification_report(df).collect()}
    assert got["up"]["precision"] == 0.5 and got["down"]["recall"] == pytest.approx(2 / 3)
    assert got["macro avg"]["support"] == got["weighted avg"]["support"] == 5
    assert got["weighted avg"]["recall"] == pytest.approx(0.6)


def test_gates_and_rollback(spark):
    m = spark.createDataFrame([("good", 0.6, 0.5, 0.6, 0.5, 0.5), ("bad", 0.48, 0.28, None, 0.2, 0.3)], "model string, accuracy double, f1 double, roc_auc double, recall double, precision double")
    passed = {(r["model"], r["metric"]): r["passed"] for r in met.quality_gate(m).collect()}
    assert all(passed["good", k] for k in met.QUALITY_GATES) and not any(passed["bad", k] for k in met.QUALITY_GATES)
    calm = spark.createDataFrame([("none",)], "severity string")
    quiet = spark.createDataFrame([(False,)], "over_limit boolean")
    got = {r["model"]: r["rollback"] for r in met.rollback_decision(m, calm, quiet).collect()}
    assert got == {"good": False, "bad": True}
    rates = spark.createDataFrame([("a", 0.05), ("b", 0.02), ("c", 0.01)], "kind string, rate double")
    assert met.error_total(rates).collect()[0]["over_limit"] is True


def test_versions(spark):
    reg = spark.createDataFrame([("m", "9", 1.0), ("m", "10", 2.0)], "model string, version string, f1 double")
    assert met.latest_version(reg).collect()[0]["version"] == "10"
    log = spark.createDataFrame(
        [("t1", "v1", "deploy"), ("t2", "v2", "deploy"), ("t3", "v3", "deploy"), ("t4", "v2", "rollback")],
        "timestamp string, version string, action string",
    )
    assert [r["timestamp"] for r in met.audit_search(log, "v2", "rollback").collect()] == ["t4"]
    v = spark.createDataFrame([("v1", 0.47, 0.50, 0.53), ("v2", 0.48, 0.51, 0.54)], "version string, f1 double, accuracy double, roc_auc double")
    got = met.compare_versions(v).where("version = 'v2'").collect()
    assert all(r["improved"] for r in got) and len(got) == 3


def test_leaderboard_and_weights(spark):
    m = spark.createDataFrame([("a", 0.2), ("b", 0.6), ("c", 0.2)], "model string, f1 double")
    assert [r["model"] for r in met.leaderboard(m).orderBy("position").collect()] == ["b", "a", "c"]
    assert met.best_model(m).collect()[0]["model"] == "b"
    assert sum(r["weight"] for r in met.f1_weights(m).collect()) == pytest.approx(1.0)


def test_rules_at_their_limits(spark):
    x = F.col("x")

    def values(xs, fn):
        return [r[0] for r in spark.createDataFrame([(v,) for v in xs], "x double").select(fn(x)).collect()]

    assert values([70.0, 69.9, 60.0, 59.9], rules.signal_strength) == ["STRONG", "MODERATE", "MODERATE", "WEAK"]
    assert values([0.7, 0.71, 0.3, 0.29], rules.batch_confidence) == ["WEAK", "STRONG", "WEAK", "STRONG"]
    assert values([0.6, 0.61, 0.55, 0.56], rules.next_signal) == ["MODERATE", "STRONG", "WEAK", "MODERATE"]
    assert values([0.049, 0.05, 0.1, 0.25], rules.psi_label) == ["none", "low", "moderate", "significant"]
    assert values([0.0, 3.0, 4.0], rules.drift_action) == ["none", "monitor", "retrain"]
    assert values([0.0, 2.0, 3.0], rules.drift_severity) == ["none", "moderate", "significant"]
    assert values([30.0, 30.1, 70.0], rules.rsi_zone) == ["extreme", "neutral", "extreme"]
    assert values([2.5, 3.5, 0.125], lambda c: rules.round_half_even(c, 0)) == [2.0, 4.0, 0.0]


def test_signals(spark):
    df = spark.createDataFrame([(0.7, 1), (0.4, 0), (0.55, 1)], "score double, pred int")
    got = scoring.signals(df).collect()
    assert [(r["direction"], r["signal_strength"]) for r in got] == [("UP", "STRONG"), ("DOWN", "MODERATE"), ("UP", "WEAK")]
    assert all(r["probability_up"] + r["probability_down"] == pytest.approx(1.0) for r in got)
    assert got[1]["confidence"] == 60.0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 101])
def test_time_split_sizes(spark, make_bars, n):
    split = prep.time_split(make_bars([float(i) for i in range(n)]))
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    n_test = -(-n // 5)
    assert got.get("test", 0) == n_test and got.get("train", 0) == n - n_test
    if n > n_test:
        edge = split.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
        by = {r["split"]: r for r in edge}
        assert by["train"]["hi"] < by["test"]["lo"]


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    got = {r["feature"]: (r["mean"], r["std"]) for r in prep.fit_scaler(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1.0), "b": (7.0, 1.0)}
    out = prep.apply_scaler(df, prep.fit_scaler(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_scaler_fit_on_train_only(spark):
    rows = [(float(i), "train" if i < 8 else "test") for i in range(10)]
    df = spark.createDataFrame(rows, "a double, split string")
    out = prep.scale_features(df, ["a"], fit_on="train")
    assert out.where("split = 'train'").agg(F.avg("a")).collect()[0][0] == pytest.approx(0.0)
    assert prep.scale_features(df, ["a"], fit_on="all").agg(F.avg("a")).collect()[0][0] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        prep.scale_features(df, ["a"], fit_on="test")


@pytest.mark.parametrize("k", [3, 5])
def test_stratified_folds(spark, make_bars, k):
    rng = np.random.default_rng(k)
    bars = make_bars([float(x) for x in rng.integers(0, 9, 83)])
    labelled = bars.withColumn("target", (F.col("close") > 5).cast("int"))
    got = prep.stratified_folds(labelled, k).orderBy("ts").toPandas()
    y = got["target"].to_numpy()
    sorted_y = np.sort(y)
    for c in (0, 1):
        sizes = [(sorted_y[i::k] == c).sum() for i in range(k)]
        want = np.repeat(np.arange(k), sizes)
        assert got.loc[got.target == c, "fold"].tolist() == want.tolist()


def test_width_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "features array<double>")
    good, bad = prep.split_by_width(df, 2)
    assert good.count() == 1 and bad.count() == 2


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "target int")
    got = {r["target"]: r["weight"] for r in prep.class_weights(df).collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    per_row = {r["target"]: r["weight"] for r in prep.with_class_weight(df).distinct().collect()}
    assert per_row == got


def test_sample_is_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"] for r in prep.sample_rows(df, "k", 0.3).collect()}
    b = {r["k"] for r in prep.sample_rows(df.repartition(5), "k", 0.3).collect()}
    assert a == b and 0.25 < len(a) / 5000 < 0.35


def test_versions_in_numeric_order(spark):
    rows = [(v, float(i)) for i, v in enumerate(("v8", "v9", "v10"))]
    got = met.compare_versions(spark.createDataFrame(rows, "version string, f1 double"), ["f1"]).collect()
    assert {r["version"]: r["previous"] for r in got} == {"v8": None, "v9": 0.0, "v10": 1.0}
