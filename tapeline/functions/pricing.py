"""European calls without dividends, as expressions that stay in the JVM.

Invalid inputs (spot, strike, time or volatility not positive) give null; strict=True raises.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def norm_cdf(x: Column) -> Column:
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    upper = F.lit(0.5) * (F.lit(1.0) + (F.lit(1.0) - poly * F.exp(-z * z)))
    return F.when(x >= 0, upper).otherwise(F.lit(1.0) - upper)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / F.lit(2.0)) / F.lit(math.sqrt(2.0 * math.pi))


def _d1(spot, strike, tte, vol, rate) -> Column:
    return (F.ln(spot / strike) + (rate + vol * vol / 2.0) * tte) / (vol * F.sqrt(tte))


def _guarded(value: Column, spot, strike, tte, vol, strict: bool) -> Column:
    valid = (spot > 0) & (strike > 0) & (tte > 0) & (vol > 0)
    return F.when(valid, value).otherwise(F.raise_error(F.lit("spot, strike, time and volatility must be positive")).cast("double") if strict else F.lit(None).cast("double"))


def call_price(spot, strike, tte, vol, rate=0.0, strict: bool = False) -> Column:
    spot, strike, tte, vol, rate = map(_col, (spot, strike, tte, vol, rate))
    d1 = _d1(spot, strike, tte, vol, rate)
    value = spot * norm_cdf(d1) - strike * F.exp(-rate * tte) * norm_cdf(d1 - vol * F.sqrt(tte))
    return _guarded(value, spot, strike, tte, vol, strict)


def call_delta(spot, strike, tte, vol, rate=0.0, strict: bool = False) -> Column:
    spot, strike, tte, vol, rate = map(_col, (spot, strike, tte, vol, rate))
    return _guarded(norm_cdf(_d1(spot, strike, tte, vol, rate)), spot, strike, tte, vol, strict)


def vega(spot, strike, tte, vol, rate=0.0, strict: bool = False) -> Column:
    spot, strike, tte, vol, rate = map(_col, (spot, strike, tte, vol, rate))
    return _guarded(spot * norm_pdf(_d1(spot, strike, tte, vol, rate)) * F.sqrt(tte), spot, strike, tte, vol, strict)


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * z)
    poly = np.zeros_like(t)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    upper = 0.5 * (1.0 + (1.0 - poly * np.exp(-z * z)))
    return np.where(x >= 0, upper, 1.0 - upper)


def _calls(spot, strike, tte, vol, rate) -> np.ndarray:
    root = vol * np.sqrt(tte)
    d1 = (np.log(spot / strike) + (rate + vol * vol / 2.0) * tte) / root
    return spot * _cdf(d1) - strike * np.exp(-rate * tte) * _cdf(d1 - root)


def implied_vol(price: Column, spot: Column, strike, tte: Column, rate=0.0, low: float = 1e-6, high: float = 5.0, tolerance: float = 1e-6) -> Column:
    """The volatility that gives the price, by bisection; null if low and high don't bracket it.

    The number of halvings depends on the bounds alone. They run on whole Arrow batches in numpy: the
    same loop as a fold of expressions took 40 times as long, since a fold is interpreted and
    evaluates every use of a term anew. Marked as not deterministic so that no filter repeats it.
    """
    steps = max(0, math.ceil(math.log2((high - low) / tolerance)))

    @F.pandas_udf("double")
    def bisect(price: pd.Series, spot: pd.Series, strike: pd.Series, tte: pd.Series, rate: pd.Series) -> pd.Series:
        p, s, k, t, r = (x.to_numpy(dtype=float, na_value=np.nan) for x in (price, spot, strike, tte, rate))
        with np.errstate(all="ignore"):
            ok = (s > 0) & (k > 0) & (t > 0)
            lo, hi = np.full(len(p), low), np.full(len(p), high)
            ok &= (_calls(s, k, t, lo, r) <= p) & (_calls(s, k, t, hi, r) >= p)
            for _ in range(steps):
                mid = (lo + hi) / 2.0
                below = _calls(s, k, t, mid, r) < p
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series((lo + hi) / 2.0).where(ok)

    return bisect.asNondeterministic()(price, spot, _col(strike), tte, _col(rate))


#: Bounds of a total deviation, vol * sqrt(tte), and the halvings that find one.
LEAST_DEVIATION, MOST_DEVIATION, HALVINGS = 1e-9, 64.0, 36


def deviation_range(price: Column, spot: Column, strike) -> Column:
    """struct(low, high): the total deviations vol * sqrt(tte) at which a call at rate 0 has the price. They are all that
    a price tells, whatever the expiry; low and high differ only where the price does not depend on them, as for
    calls at their intrinsic value. Null if no deviation gives the price. Two bisections a quote, in numpy on Arrow batches.
    """

    @F.pandas_udf("low double, high double")
    def bisect(price: pd.Series, spot: pd.Series, strike: pd.Series) -> pd.DataFrame:
        p, s, k = (x.to_numpy(dtype=float, na_value=np.nan) for x in (price, spot, strike))
        with np.errstate(all="ignore"):
            ok = (s > 0) & (k > 0)
            worth = lambda w: _calls(s, k, 1.0, w, 0.0)
            first, last = (np.full(len(p), x) for x in (LEAST_DEVIATION, MOST_DEVIATION))
            ok &= (worth(first) <= p) & (worth(last) >= p)
            found = []
            for short in (np.less, np.less_equal):
                lo, hi = first, last
                for _ in range(HALVINGS):
                    mid = (lo + hi) / 2.0
                    below = short(worth(mid), p)
                    lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
                found.append((lo + hi) / 2.0)
        return pd.DataFrame({name: np.where(ok, x, np.nan) for name, x in zip(("low", "high"), found)})

    return bisect.asNondeterministic()(price, spot, _col(strike))


def vol_of_deviation(deviation: Column, tte: Column, low: float = 1e-6, high: float = 5.0) -> Column:
    """The implied volatility at an expiry from the range of total deviations: a division; null if the volatilities low and
    high don't bracket the price, which grows with the deviation."""
    root = F.sqrt(tte)
    bracketed = (F.lit(low) * root <= deviation["high"]) & (F.lit(high) * root >= deviation["low"])
    return F.when(bracketed, F.greatest(deviation["low"] / root, F.lit(low)))


def time_to_expiry(day: Column, timestamp: Column, expiry_day=8.25, per_day: float = 1_000_000.0) -> Column:
    return _col(expiry_day) - day - timestamp.cast("double") / F.lit(per_day)


def strike_of(product: Column, prefix: str) -> Column:
    """The number after `prefix_` in an option's name; null for other names."""
    return F.regexp_extract(product, rf"^{prefix}_(\d+)$", 1).try_cast("int")
