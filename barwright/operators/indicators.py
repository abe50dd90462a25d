"""Indicator features over bars.

All outputs share one (series, bucket) order, so a table of features costs one
exchange and one sort however many are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barwright.functions.rolling import roll
from barwright.functions.rules import ratio
from barwright.operators.layout import Layout, _renamed, core_rows, slice_table, stored_rows, with_halo
from barwright.session import materialize
from barwright.schema import INDICATORS

RSI_PERIOD = ATR_PERIOD = 14
BAND_PERIOD = 20

# Rows a feature looks back at: its frame, plus one row where it starts from a difference.
LOOKBACK = 20
SHORT_LOOKBACK = {
    "high_low_ratio": 0, "close_open_ratio": 0, "body_size": 0, "returns": 1, "log_returns": 1, "gap": 1,
    "volatility_5": 5, "momentum_5": 5, "volatility_10": 10, "momentum_10": 10, "rsi": 15, "atr": 15,
}
DECLARED_LOOKBACK = 50

# Features the served list names beside the indicators above.
DECLARED = [
    "returns_1h",
    "returns_2h",
    "returns_4h",
    "returns_8h",
    "returns_24h",
    "volatility_4h",
    "volatility_8h",
    "volatility_24h",
    "ma_5",
    "ma_10",
    "ma_20",
    "ma_50",
    "momentum_20",
    "roc_5",
    "roc_10",
    "bb_middle",
    "bb_width",
    "stoch_k",
    "stoch_d",
    "volume_ma_5",
    "volume_ma_20",
    "hour",
    "day_of_week",
    "is_weekend",
]


def true_range(prev: Column) -> Column:
    """Largest of the three ranges; ``greatest`` skips the NULLs of the first row."""
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - prev),
        F.abs(F.col("low") - prev),
    )


def _rolled(w: WindowSpec, names: set[str]) -> dict[str, Column]:
    """Each rolling aggregate and each frame count once; several outputs share them.

    Equal window expressions are not merged by the planner, so they are named
    here and the outputs are plain arithmetic over the names.
    """
    c, v, d = F.col("close"), F.col("volume"), F.col("__prev_delta")

    def over(column: Column, n: int) -> Column:
        return column.over(w.rowsBetween(-(n - 1), 0))

    bands = {"bb_upper", "bb_lower", "bb_position"}
    volume = {"volume_sma", "volume_ratio"}
    tr = true_range(F.col("__prev"))
    uses: dict[str, tuple[set[str], Column]] = {
        "__n5": ({"volatility_5"}, over(F.count(c), 5)),
        "__std5": ({"volatility_5"}, over(F.stddev_samp(c), 5)),
        "__n10": ({"volatility_10"}, over(F.count(c), 10)),
        "__std10": ({"volatility_10"}, over(F.stddev_samp(c), 10)),
        "__n20": (bands, over(F.count(c), BAND_PERIOD)),
        "__sma20": (bands, over(F.avg(c), BAND_PERIOD)),
        "__std20": (bands, over(F.stddev_samp(c), BAND_PERIOD)),
        "__rows14": ({"rsi"}, over(F.count(F.lit(1)), RSI_PERIOD)),
        "__gain": ({"rsi"}, over(F.avg(F.when(d > 0, d).otherwise(0.0)), RSI_PERIOD)),
        "__loss": ({"rsi"}, over(F.avg(F.when(d < 0, -d).otherwise(0.0)), RSI_PERIOD)),
        "__ntr": ({"atr"}, over(F.count(tr), ATR_PERIOD)),
        "__atr": ({"atr"}, over(F.avg(tr), ATR_PERIOD)),
        "__nv20": (volume, over(F.count(v), BAND_PERIOD)),
        "__vsma": (volume, over(F.avg(v), BAND_PERIOD)),
        "__close5": ({"momentum_5"}, F.lag("close", 5).over(w)),
        "__close10": ({"momentum_10"}, F.lag("close", 10).over(w)),
    }
    return {k: column for k, (outputs, column) in uses.items() if names & outputs}


def relative_strength(gain: Column, loss: Column) -> Column:
    """Strength index on plain means of gains and losses.

    A missing change counts as no gain and no loss.  No loss in the frame gives
    100, neither gain nor loss gives NULL.
    """
    return (
        F.when((loss == 0) & (gain > 0), 100.0)
        .when(loss == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(100.0) - F.try_divide(F.lit(100.0), F.try_divide(gain, loss) + 1))
    )


def indicator_columns() -> dict[str, Column]:
    """The seventeen indicators as arithmetic over ``__prev`` and the rolled columns."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))

    def full(count: str, n: int, value: str) -> Column:
        return F.when(F.col(count) == n, F.col(value))

    prev = F.col("__prev")
    sma, std = full("__n20", BAND_PERIOD, "__sma20"), full("__n20", BAND_PERIOD, "__std20")
    volume_sma = full("__nv20", BAND_PERIOD, "__vsma")
    gain, loss = full("__rows14", RSI_PERIOD, "__gain"), full("__rows14", RSI_PERIOD, "__loss")
    upper, lower = sma + std * 2, sma - std * 2
    return {
        "volatility_5": full("__n5", 5, "__std5"),
        "volatility_10": full("__n10", 10, "__std10"),
        "returns": ratio(c, prev) - 1,
        "log_returns": F.ln(ratio(c, prev)),
        "rsi": relative_strength(gain, loss),
        "bb_upper": upper,
        "bb_lower": lower,
        "bb_position": ratio(c - lower, upper - lower),
        "atr": full("__ntr", ATR_PERIOD, "__atr"),
        "volume_sma": volume_sma,
        "volume_ratio": ratio(v, volume_sma + 1e-8),
        "momentum_5": c - F.col("__close5"),
        "momentum_10": c - F.col("__close10"),
        "high_low_ratio": ratio(h, lo),
        "close_open_ratio": ratio(c, o),
        "body_size": ratio(F.abs(c - o), o),
        "gap": ratio(o - prev, prev),
    }


def target_column(w: WindowSpec) -> Column:
    """1 if the next close is higher; the last row of a series has none and gets 0."""
    return F.coalesce(F.lead("close").over(w) > F.col("close"), F.lit(False)).cast("int")


def add_indicators(
    bars: DataFrame,
    names: Iterable[str] = INDICATORS,
    layout: Layout = Layout(),
    label: bool = False,
    keep_bucket: bool = False,
) -> DataFrame:
    """Bars plus the named indicators and, if asked for, the ``target`` label.

    The halo is as long as the named indicators need; those of a single bar are a projection.
    """
    names = list(names)
    w = layout.window()
    back = max([0, *(SHORT_LOOKBACK.get(n, LOOKBACK) for n in names)])
    if not (back or label or keep_bucket):
        every = indicator_columns()
        return bars.select(*bars.columns, *[every[n].alias(n) for n in names])
    rows = with_halo(bars, layout, back=back, ahead=1 if label else 0)
    rows = rows.withColumn("__prev", F.lag("close").over(w))
    rolled = _rolled(w, set(names))
    if label:
        rolled["target"] = target_column(w)
    if rolled:
        rows = rows.withColumn("__prev_delta", F.col("close") - F.col("__prev")).withColumns(rolled)
    every = indicator_columns()
    columns = [every[n].alias(n) for n in names] + (["target"] if label else [])
    return core_rows(rows.select(*bars.columns, *columns, "__bucket", "__core"), keep_bucket)


def add_target(bars: DataFrame, layout: Layout = Layout(), drop_last: bool = False) -> DataFrame:
    """The label alone.  ``drop_last`` leaves out rows without a following bar."""
    w = layout.window()
    rows = with_halo(bars, layout, back=0, ahead=1).withColumn("target", target_column(w))
    if drop_last:
        rows = rows.withColumn("__has_next", F.lead(F.lit(1)).over(w).isNotNull())
    out = core_rows(rows)
    return out.where("__has_next").drop("__has_next") if drop_last else out


def add_delta(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    change = F.col("close") - F.lag("close").over(layout.window())
    return core_rows(with_halo(bars, layout, back=1).withColumn("delta", change))


def add_true_range(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    rows = with_halo(bars, layout, back=1).withColumn("__prev", F.lag("close").over(layout.window()))
    return core_rows(rows.withColumn("true_range", true_range(F.col("__prev"))).drop("__prev"))


def add_declared_features(
    bars: DataFrame, names: Iterable[str] = DECLARED, layout: Layout = Layout()
) -> DataFrame:
    """Features that the served list only names, by their textbook definitions."""
    names = list(names)
    wanted = set(names)
    w = layout.window()
    c, v = F.col("close"), F.col("volume")

    def back(k: int) -> Column:
        return F.col(f"__close{k}")

    uses: dict[str, tuple[tuple[str, ...], Column]] = {
        f"__close{k}": (users, F.lag("close", k).over(w))
        for k, users in {
            1: ("returns_1h", "volatility_4h", "volatility_8h", "volatility_24h"),
            2: ("returns_2h",),
            4: ("returns_4h",),
            5: ("roc_5",),
            8: ("returns_8h",),
            10: ("roc_10",),
            20: ("momentum_20",),
            24: ("returns_24h",),
        }.items()
    }
    uses["__low14"] = (("stoch_k", "stoch_d"), roll(F.min, F.col("low"), 14, w))
    uses["__high14"] = (("stoch_k", "stoch_d"), roll(F.max, F.col("high"), 14, w))
    uses |= {f"__ma{k}": ((f"ma_{k}",), roll(F.avg, c, k, w)) for k in (5, 10, 50)}
    uses["__ma20"] = (("ma_20", "bb_middle", "bb_width"), roll(F.avg, c, 20, w))
    uses["__std20"] = (("bb_width",), roll(F.stddev_samp, c, 20, w))
    uses |= {f"__vma{k}": ((f"volume_ma_{k}",), roll(F.avg, v, k, w)) for k in (5, 20)}
    first = {k: col for k, (users, col) in uses.items() if wanted & set(users)}

    second: dict[str, Column] = {}
    returns, stoch = ratio(c, back(1)) - 1, ratio((c - F.col("__low14")) * 100, F.col("__high14") - F.col("__low14"))
    second |= {
        f"volatility_{k}h": roll(F.stddev_samp, returns, k, w) for k in (4, 8, 24) if f"volatility_{k}h" in wanted
    }
    if "stoch_d" in wanted:
        second["stoch_d"] = roll(F.avg, stoch, 3, w)

    every = {f"returns_{k}h": ratio(c, back(k)) - 1 for k in (1, 2, 4, 8, 24)}
    every |= {f"volatility_{k}h": F.col(f"volatility_{k}h") for k in (4, 8, 24)}
    every |= {f"ma_{k}": F.col(f"__ma{k}") for k in (5, 10, 20, 50)}
    every["momentum_20"] = c - back(20)
    every |= {f"roc_{k}": (ratio(c, back(k)) - 1) * 100 for k in (5, 10)}
    every["bb_middle"] = F.col("__ma20")
    every["bb_width"] = (F.col("__ma20") + F.col("__std20") * 2) - (F.col("__ma20") - F.col("__std20") * 2)
    every["stoch_k"] = stoch
    every["stoch_d"] = F.col("stoch_d")
    every |= {f"volume_ma_{k}": F.col(f"__vma{k}") for k in (5, 20)}
    every["hour"] = F.hour("ts")
    every["day_of_week"] = F.weekday("ts")
    every["is_weekend"] = (F.weekday("ts") >= 5).cast("int")

    columns = [every[n].alias(n) for n in names]
    if not first:
        return bars.select(*bars.columns, *columns)
    rows = with_halo(bars, layout, back=DECLARED_LOOKBACK).withColumns(first)
    if second:
        rows = rows.withColumns(second)
    return core_rows(rows.select(*bars.columns, *columns, "__bucket", "__core"))


# The spans of the averages that are named.
EMA_SPANS = (5, 10, 20, 12, 26)
SIGNAL_SPAN = 9

EMA_COLUMNS = [*[f"ema_{n}" for n in EMA_SPANS], "macd", "macd_signal"]


def _scan(x, alpha: float, starts, states):
    """Exponential averages of ``x`` along segments that begin at ``starts``, all segments at once.

    ``states`` holds what each segment begins with; where it is missing the first value does. A segment longer
    than a few steps is taken 32 steps at a time: within them the recursion is a running sum of scaled values.
    """
    import numpy as np

    out = np.empty(len(x))
    lengths = np.diff(np.append(starts, len(x)))
    fresh = np.isnan(states)
    state = np.where(fresh, np.nan, states)
    keep = 1.0 - alpha
    decay = keep ** np.arange(1, 33)
    done = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(lengths)
    if len(live):
        first = starts[live]
        state[live] = np.where(fresh[live], x[first], state[live])
    while len(live):
        width = int(min(32, (lengths[live] - done[live]).max()))
        at = (starts[live] + done[live])[:, None] + np.arange(width)
        inside = np.arange(width) < (lengths[live] - done[live])[:, None]
        part = np.where(inside, x[np.minimum(at, len(x) - 1)], 0.0)
        sums = np.cumsum(part * (alpha / decay[:width]), axis=1)
        found = decay[:width] * (state[live][:, None] + sums)
        out[at[inside]] = found[inside]
        count = np.minimum(lengths[live] - done[live], width)
        state[live] = found[np.arange(len(live)), count - 1]
        done[live] += count
        live = live[done[live] < lengths[live]]
    return out, state


def _averages(close, starts, states):
    """(columns of EMA_COLUMNS, end states per segment) of closes in segments; missing closes change nothing.

    ``states`` has a row per segment and a column per average, the signal last; NaN where nothing came before.
    """
    import numpy as np

    n, k = len(close), len(EMA_SPANS)
    segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    known = ~np.isnan(close)
    upto = np.cumsum(known)
    before = (upto - known)[starts] if n else np.zeros(0, np.int64)
    seen = upto - before[segment]  # known closes of the segment so far
    x, ends = close[known], np.empty((len(starts), k + 1))
    compact = np.append(before, upto[-1] if n else 0)[:-1]
    out = np.full((k + 2, n), np.nan)
    for i, span in enumerate(EMA_SPANS):
        y, ends[:, i] = _scan(x, 2.0 / (span + 1), compact, states[:, i])
        held = states[segment, i]
        out[i] = np.where(seen > 0, np.append(y, np.nan)[np.maximum(upto - 1, 0)], held) if n else out[i]
    out[k] = out[EMA_SPANS.index(12)] - out[EMA_SPANS.index(26)]
    told = ~np.isnan(out[k])
    counts = np.cumsum(told)
    s, ends[:, k] = _scan(out[k][told], 2.0 / (SIGNAL_SPAN + 1), (counts - told)[starts] if n else np.zeros(0, np.int64), states[:, k])
    out[k + 1][told] = s
    return out, ends


def _effects(close, starts):
    """What each segment does to the states before it: (first closes' end states, base, what is left of each, signal's shares)."""
    import numpy as np

    n, k = len(close), len(EMA_SPANS)
    none, zero = np.full((len(starts), k + 1), np.nan), np.zeros((len(starts), k + 1))
    first = _averages(close, starts, none)[1]
    base = _averages(close, starts, zero)[1]
    silent = np.where(np.isnan(close), np.nan, 0.0)
    left = _averages(silent, starts, np.ones((len(starts), k + 1)) * np.append(np.ones(k), 0.0))[1][:, :k]
    shares = []
    for i in (EMA_SPANS.index(12), EMA_SPANS.index(26), k):
        one = zero.copy()
        one[:, i] = 1.0
        shares.append(_averages(silent, starts, one)[1][:, k])
    return first, base, left, np.stack(shares, axis=1) if n else np.zeros((0, 3))


def add_ema(bars: DataFrame, layout: Layout = Layout(), pack_rows: int = 50_000) -> DataFrame:
    """Exponential averages (seeded with the first close), MACD and its signal.

    The recursion is linear, so what a bucket does to the states is known without them: its end states from zero,
    and the share of each start state that is left. For series of several buckets these few numbers are chained,
    and each bucket then runs from its true start; a series of one bucket needs neither. Buckets are packed, many
    to a group of about ``pack_rows`` rows, and all of a pack are scanned at once. No row is copied, and a run of
    missing closes may have any length.
    """
    import numpy as np
    import pandas as pd

    keys, order = list(layout.keys), layout.order()
    rows = stored_rows(bars.select(*keys, *order, "close"), layout)
    slices = slice_table(rows, layout)
    total = slices.agg(F.sum(F.col("__end") - F.col("__start"))).first()[0] or 0
    packs = max(1, -(-total // pack_rows))
    at = [*keys, "__bucket"]
    several = F.col("__total") > F.max("__end").over(Window.partitionBy(*at))
    places = slices.select(*keys, "__slice", "__bucket", (several | (F.col("__bucket") > 0)).alias("__several"))
    places, on = _renamed(materialize(places, "places"), layout, "__slice")
    pack = F.pmod(F.xxhash64(*at), F.lit(packs)).alias("__pack")
    rows = rows.withColumn("__slice", layout.slice_of()).join(places, on).select(*keys, *order, "close", "__bucket", "__several")
    rows = rows.select("*", pack)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    heads = ", ".join(f"`{c}` {types[c]}" for c in at)
    ends = [f"s{i}" for i in range(len(EMA_SPANS) + 1)]
    k = len(EMA_SPANS)

    def in_order(pdf):
        """The pack's rows by series, bucket and time, and where each bucket begins."""
        pdf = pdf.sort_values([*at, *order], kind="stable", na_position="first").reset_index(drop=True)
        begins = pdf[at].ne(pdf[at].shift()) & ~(pdf[at].isna() & pdf[at].shift().isna())
        found = begins.any(axis=1).to_numpy()
        if len(found):
            found[0] = True
        return pdf, np.flatnonzero(found)

    def effect(pdf):
        pdf, starts = in_order(pdf)
        first, base, left, shares = _effects(pdf["close"].to_numpy(dtype=float), starts)
        out = pdf.loc[starts, at].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(np.hstack([first, base, left, shares]), columns=numbers)], axis=1)

    def chain(pdf):
        pdf = pdf.sort_values(at, kind="stable", na_position="first")
        states = np.full((len(pdf), k + 1), np.nan)
        values, names = pdf[numbers].to_numpy(dtype=float), pdf[keys].to_numpy(dtype=object)
        missing = pdf[keys].isna().to_numpy()
        for i in range(1, len(pdf)):
            if not all(a == b or (x and y) for a, b, x, y in zip(names[i], names[i - 1], missing[i], missing[i - 1])):
                continue
            first, base, left, shares = np.split(values[i - 1], [k + 1, 2 * k + 2, 3 * k + 2])
            state = states[i - 1]
            if np.isnan(state[0]):
                states[i] = first
            else:
                states[i, :k] = base[:k] + left * state[:k]
                states[i, k] = base[k] + shares @ state[[EMA_SPANS.index(12), EMA_SPANS.index(26), k]]
        return pd.concat([pdf[at].reset_index(drop=True), pd.DataFrame(states, columns=ends)], axis=1)

    def run(pdf, starting):
        pdf, starts = in_order(pdf)
        states = np.full((len(starts), k + 1), np.nan)
        if len(starting):
            where = pdf.loc[starts, at].reset_index(drop=True)
            where["__at"] = range(len(where))
            found = where.merge(starting[[*at, *ends]], on=at, how="inner")
            states[found["__at"].to_numpy()] = found[ends].to_numpy(dtype=float)
        out, _ = _averages(pdf["close"].to_numpy(dtype=float), starts, states)
        return pd.concat([pdf, pd.DataFrame(out.T, columns=EMA_COLUMNS)], axis=1)

    numbers = [f"{p}{i}" for p, m in (("f", k + 1), ("b", k + 1), ("l", k), ("h", 3)) for i in range(m)]
    effects = rows.where("__several").groupBy("__pack").applyInPandas(effect, heads + "".join(f", {n} double" for n in numbers))
    links = effects.withColumn("__pack", F.pmod(F.xxhash64(*keys), F.lit(packs)))
    starts = links.groupBy("__pack").applyInPandas(chain, heads + "".join(f", {n} double" for n in ends))
    starts = materialize(starts.withColumn("__pack", F.pmod(F.xxhash64(*at), F.lit(packs))), "states")
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + "".join(f", {n} double" for n in EMA_COLUMNS)
    return rows.groupBy("__pack").cogroup(starts.groupBy("__pack")).applyInPandas(run, schema).drop("__bucket", "__several", "__pack")
