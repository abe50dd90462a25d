"""Indicators on hand cases, and split windows against whole-series ones."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

from barwright.operators.indicators import (
    DECLARED,
    add_declared_features,
    add_ema,
    add_indicators,
    add_target,
    add_true_range,
)
from barwright.operators.layout import Layout, with_halo, with_row_index
from barwright.schema import INDICATORS


def ordered(df):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def gappy(spark):
    """Five random walks with missing hours, flat stretches and some empty days."""
    rng = np.random.default_rng(7)
    parts = []
    for s in range(5):
        keep = rng.random(500) < (0.9, 0.6, 0.3, 0.1, 0.02)[s]
        keep[200:260] = False
        hours = np.flatnonzero(keep)
        close = 100 + np.cumsum(rng.integers(-3, 4, len(hours))).astype(float)
        close[len(close) // 3 : len(close) // 2] = 50.0
        parts.append(
            pd.DataFrame(
                {
                    "series_id": f"s{s}",
                    "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"),
                    "open": close + 0.5,
                    "high": close + rng.random(len(hours)),
                    "low": close - rng.random(len(hours)),
                    "close": close,
                    "volume": rng.integers(1, 50, len(hours)).astype(float),
                }
            )
        )
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).selectExpr(
        "series_id", "cast(ts as timestamp_ntz) ts", "open", "high", "low", "close", "volume"
    )
    return df


@pytest.mark.parametrize("slice_bars,slices", [(1, 1), (4, 6), (16, 2)])
def test_split_buckets_equal_whole_series(gappy, slice_bars, slices):
    whole = ordered(add_indicators(gappy, label=True))
    split = ordered(add_indicators(gappy, layout=Layout(slice_bars=slice_bars, slices_per_bucket=slices), label=True))
    pd.testing.assert_frame_equal(whole, split, check_exact=True)


def test_indicators_match_pandas(gappy):
    got = ordered(add_indicators(gappy, label=True))
    for _, g in got.groupby("series_id"):
        c = g["close"]
        d = c.diff()
        gain = d.where(d > 0, 0.0).rolling(14).mean()
        loss = (-d.where(d < 0, 0.0)).rolling(14).mean()
        expect = {
            "volatility_5": c.rolling(5).std(),
            "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std(),
            "returns": c / c.shift(1) - 1,
            "momentum_10": c - c.shift(10),
            "volume_sma": g["volume"].rolling(20).mean(),
            "gap": (g["open"] - c.shift(1)) / c.shift(1),
        }
        for name, want in expect.items():
            np.testing.assert_allclose(g[name], want, atol=1e-6, err_msg=name)
        clear = (loss > 1e-9).to_numpy()
        np.testing.assert_allclose(g["rsi"][clear], (100 - 100 / (1 + gain / loss))[clear], atol=1e-6)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - c.shift(1)).abs(), (g["low"] - c.shift(1)).abs()], axis=1)
        np.testing.assert_allclose(g["atr"], tr.max(axis=1).rolling(14).mean(), atol=1e-9)
        np.testing.assert_array_equal(g["target"], (c.shift(-1) > c).astype(int))


def test_rising_closes(make_bars):
    got = ordered(add_indicators(make_bars([float(i) for i in range(1, 21)]), ["rsi"]))
    assert got["rsi"][:13].isna().all()
    assert (got["rsi"][13:] == 100.0).all()


def test_constant_close(make_bars):
    got = ordered(add_indicators(make_bars([5.0] * 20), label=True))
    assert got["rsi"].isna().all() and got["bb_position"].isna().all()
    assert (got["volatility_5"][4:] == 0).all()
    assert (got["target"] == 0).all()


@pytest.mark.parametrize("n", [1, 13, 14, 20])
def test_warm_up_lengths(make_bars, n):
    close = [10.0 + (i * 7 % 5) for i in range(n)]
    got = ordered(add_indicators(make_bars(close), INDICATORS))
    for name, first in {"volatility_5": 5, "rsi": 14, "atr": 14, "bb_upper": 20, "volume_sma": 20}.items():
        assert got[name].notna().sum() == max(0, n - first + 1), name


def test_missing_close_empties_its_frames(make_bars):
    close = [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    got = ordered(add_indicators(make_bars(close), ["volatility_5", "returns"]))
    assert got["volatility_5"].notna().tolist() == [False] * 8 + [True] * 2
    assert got["returns"].isna().tolist()[3:5] == [True, True]


def test_zero_prices_give_null_not_errors(make_bars):
    got = ordered(add_indicators(make_bars([0.0, 1.0, 0.0], low=[0.0, 0.0, 0.0])))
    assert got["returns"].isna().tolist() == [True, True, False]
    assert got["log_returns"].isna().all() and got["high_low_ratio"].isna().all()


def test_true_range_and_atr_case(make_bars):
    bars = make_bars(
        [105.0, 105.0, 104.0, 107.0, 105.0],
        high=[110.0, 111.0, 109.0, 112.0, 110.0],
        low=[100.0, 101.0, 99.0, 102.0, 100.0],
    )
    assert ordered(add_true_range(bars))["true_range"].tolist() == [10.0] * 5


def test_last_row_label(make_bars):
    bars = make_bars([1.0, 2.0, 3.0])
    assert ordered(add_target(bars))["target"].tolist() == [1, 1, 0]
    assert ordered(add_target(bars, drop_last=True))["target"].tolist() == [1, 1]


def test_declared_features_split_equal_whole(gappy):
    whole = ordered(add_declared_features(gappy))
    split = ordered(add_declared_features(gappy, layout=Layout(slice_bars=5, slices_per_bucket=3)))
    pd.testing.assert_frame_equal(whole, split, check_exact=True)
    assert set(DECLARED) <= set(whole.columns)
    k = whole["stoch_k"].dropna()
    assert ((k >= -1e-9) & (k <= 100 + 1e-9)).all()


def test_ema_split_equals_recursion(gappy):
    got = ordered(add_ema(gappy, Layout(slice_bars=8, slices_per_bucket=2)))
    for _, g in got.groupby("series_id"):
        for span in (5, 12, 26):
            e, want = None, []
            for c in g["close"]:
                e = c if e is None else e + 2.0 / (span + 1) * (c - e)
                want.append(e)
            np.testing.assert_allclose(g[f"ema_{span}"], want, rtol=1e-12)


def test_row_index(gappy):
    got = ordered(with_row_index(gappy, Layout(slice_bars=3, slices_per_bucket=2), total="n"))
    want = got.groupby("series_id").cumcount()
    assert (got["row_id"] == want).all()
    assert (got["n"] == got.groupby("series_id")["ts"].transform("size")).all()


def test_null_series_keeps_its_halo(spark, gappy):
    unnamed = gappy.where("series_id = 's1'").selectExpr("cast(null as string) series_id", *gappy.columns[1:])
    small = Layout(slice_bars=2, slices_per_bucket=2)
    whole, split = add_indicators(unnamed), add_indicators(unnamed, layout=small)
    assert whole.exceptAll(split).count() == 0
    assert with_row_index(unnamed, small).agg({"row_id": "max"}).collect()[0][0] == unnamed.count() - 1


def test_ema_over_missing_closes_longer_than_a_bucket(make_bars):
    closes = [500.0 + i for i in range(40)] + [None] * 60 + [100.0 + i % 7 for i in range(50)]
    bars = make_bars([None] * 5 + closes, high=[1.0] * 155, low=[1.0] * 155, open=[1.0] * 155)
    whole = ordered(add_ema(bars))
    split = ordered(add_ema(bars, Layout(slice_bars=4, slices_per_bucket=2)))
    assert whole["macd_signal"].notna().sum() == 150
    for name in ("ema_5", "ema_26", "macd", "macd_signal"):
        np.testing.assert_allclose(split[name], whole[name], rtol=1e-12, atol=1e-9)


def test_features_of_one_bar_need_no_join(gappy):
    plan = add_indicators(gappy, ["high_low_ratio", "close_open_ratio", "body_size"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_short_halos_equal_long_ones(gappy):
    small = Layout(slice_bars=2, slices_per_bucket=2)
    for name in INDICATORS:
        one, every = ordered(add_indicators(gappy, [name], small)), ordered(add_indicators(gappy))
        pd.testing.assert_series_equal(one[name], every[name], check_exact=True)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_of_whole_rows(spark, gappy):
    """Bars are computed once and stored; then all rows are exchanged once, for the windows."""
    plan = plan_of(add_indicators(gappy, label=True, layout=Layout(slice_bars=2, slices_per_bucket=8)))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 1 and "__bucket" in exchanges[0]
    assert "LogicalRDD" not in plan and plan.count("FileScan parquet") == 2  # the stored rows and the places of slices


def test_copies_follow_rows_not_hours(spark, make_bars):
    """Sparse, regular and dense stretches: buckets of one size, and few copies for each."""
    hours = [*range(0, 4000, 40), *range(5000, 5600), *[6000 + i * 200 for i in range(100)]]
    bars = make_bars([float(i) for i in range(len(hours))], hours=hours)
    layout = Layout(slice_bars=4, slices_per_bucket=16)
    dealt = with_halo(bars, layout, back=20, ahead=1).toPandas()
    core = dealt[dealt["__core"]]
    assert sorted(core["close"]) == [float(i) for i in range(len(hours))]
    sizes = core.groupby("__bucket").size()
    assert sizes.max() <= 64 + 3 and len(sizes) == -(-len(hours) // 64)
    copies = dealt[~dealt["__core"]].groupby("__bucket").size()
    assert copies.max() <= 20 + 3 + 1 + 3
    for bucket, rows in dealt.groupby("__bucket"):
        first, last = rows.loc[rows["__core"], "close"].min(), rows.loc[rows["__core"], "close"].max()
        assert set(np.arange(max(0, first - 20), min(len(hours), last + 2))) <= set(rows["close"])


def test_scan_of_segments_matches_pandas():
    """Segments of all lengths at once, with missing closes, against one pandas average for each."""
    from barwright.operators import indicators as ind

    rng = np.random.default_rng(3)
    lengths = [1, 2, 5, 31, 32, 33, 64, 300, 1000]
    close = rng.normal(100, 5, sum(lengths))
    close[rng.random(len(close)) < 0.1] = np.nan
    close[lengths[0] + lengths[1] : lengths[0] + lengths[1] + 3] = np.nan
    starts = np.cumsum([0, *lengths[:-1]])
    out, ends = ind._averages(close, starts, np.full((len(lengths), 6), np.nan))
    for a, n in zip(starts, lengths):
        part = pd.Series(close[a : a + n])
        for i, span in enumerate(ind.EMA_SPANS):
            want = part.ewm(span=span, adjust=False, ignore_na=True).mean()
            np.testing.assert_allclose(out[i, a : a + n], want, rtol=1e-11)
        macd = part.ewm(span=12, adjust=False, ignore_na=True).mean() - part.ewm(span=26, adjust=False, ignore_na=True).mean()
        np.testing.assert_allclose(out[6, a : a + n], macd.ewm(span=9, adjust=False, ignore_na=True).mean(), rtol=1e-9, atol=1e-11)
    assert ind._averages(np.zeros(0), np.zeros(0, int), np.zeros((0, 6)))[0].shape == (7, 0)


def test_ema_of_many_series_in_packs(spark, gappy):
    """Packs of a few rows and of all rows give the same, with an unnamed series among them."""
    unnamed = gappy.where("series_id = 's1'").selectExpr("cast(null as string) series_id", *gappy.columns[1:])
    bars = gappy.union(unnamed)
    one = add_ema(bars, Layout(slice_bars=4, slices_per_bucket=4), pack_rows=40).toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    every = add_ema(bars).toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, every, check_exact=False, rtol=1e-11)
    assert len(one) == bars.count()
