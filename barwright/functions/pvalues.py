"""p-values of the two drift tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic Kolmogorov-Smirnov p-value with the small-sample
    correction of Stephens; a series of ``terms`` summands as one expression."""
    root = F.sqrt(F.try_divide(n.cast("double") * m.cast("double"), n.cast("double") + m.cast("double")))
    lam = (root + F.lit(0.12) + F.try_divide(F.lit(0.11), root)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(lam * lam * k * k * -2.0),
    )
    # Below 0.2 the p-value is 1 to twelve digits and the series converges slowly.
    p = F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2)))
    return F.when(lam.isNotNull(), p)


def ks_p_value_exact(d: Column, n: Column, m: Column) -> Column:
    """Two-sided exact Kolmogorov-Smirnov p-value of samples of n and m values, for the per-feature result table.

    Under the hypothesis all orders of the pooled sample are equally likely, so a walk over the lattice from (0, 0)
    to (n, m), drawing without replacement, gives the share of orders whose gap reaches the observed one; what
    reaches it is taken out and added up, so small values keep their digits. n + m steps over at most n numbers.
    """

    @F.pandas_udf("double")
    def reached(gaps: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.Series:
        import numpy as np

        def one(gap, n, m):
            if gap != gap or n != n or m != m or n < 1 or m < 1:
                return None
            n, m = int(n), int(m)
            limit = round(gap * n * m)
            if limit <= 0:
                return 1.0
            i = np.arange(n + 1)
            alive = np.zeros(n + 1)
            alive[0], out = 1.0, 0.0
            for k in range(n + m):  # after k draws, i of them from the first sample
                left = n + m - k
                stay = alive * np.clip(m - (k - i), 0, m) / left
                stay[1:] += alive[:-1] * (n - i[:-1]) / left
                hit = np.abs(i * m - (k + 1 - i) * n) >= limit
                out += stay[hit].sum()
                stay[hit] = 0.0
                alive = stay
            return min(out, 1.0)

        return pd.Series([one(*x) for x in zip(gaps, firsts, seconds)], dtype="float64")

    return reached(d.cast("double"), n.cast("double"), m.cast("double"))


def welch_p_value(t: Column, df: Column) -> Column:
    """Two-sided Student t p-value, evaluated on the per-feature result table only."""

    @F.pandas_udf("double")
    def two_sided(t_values: pd.Series, df_values: pd.Series) -> pd.Series:
        from math import erfc, exp, lgamma, log, log1p, nan, sqrt

        def fraction(a, b, x):
            # Continued fraction of the incomplete beta function, modified Lentz form.
            tiny = 1e-300
            c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
            d = 1.0 / (d if abs(d) > tiny else tiny)
            h = d
            for i in range(1, 100000):
                even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
                odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))
                for coef in (even, odd):
                    d = 1.0 + coef * d
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = 1.0 + coef / c
                    c = c if abs(c) > tiny else tiny
                    h *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    return h
            return nan  # not settled: no value rather than a wrong one

        def one(t_value, v):
            if t_value != t_value or v != v or v <= 0:
                return None
            tt = t_value * t_value
            if tt == 0.0:
                return 1.0
            if v > 1e8:
                return erfc(sqrt(tt / 2.0))
            a, b, x, y = v / 2.0, 0.5, v / (v + tt), tt / (v + tt)
            # lgamma(a + 1/2) - lgamma(a) cancels for a large a; use its expansion there.
            gap = 0.5 * log(a) - 1.0 / (8.0 * a) if a > 1e5 else lgamma(a + b) - lgamma(a)
            front = exp(gap - lgamma(b) - a * log1p(tt / v) + 0.5 * log(y))
            if x < (a + 1.0) / (a + b + 2.0):
                return front * fraction(a, b, x) / a
            return 1.0 - front * fraction(b, a, y) / b

        return pd.Series([one(a, b) for a, b in zip(t_values, df_values)], dtype="float64")

    return two_sided(t.cast("double"), df.cast("double"))
