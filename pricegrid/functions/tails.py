"""Distribution tails, vectorised with NumPy, exposed as pandas UDFs for result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid import values

# a type object, not a string: workers import this module without a Spark context
DOUBLE = T.DoubleType()

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def incomplete_beta(a, b, x):
    """Regularised incomplete beta by the modified Lentz continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.clip(np.where(swap, 1.0 - x, x), 0.0, 1.0)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 + even * d
        c = 1.0 + even / c
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 + odd * d
        c = 1.0 + odd / c
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if np.nanmax(np.abs(step - 1.0), initial=0.0) < 1e-14:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 0.0, 0.0, np.where(z >= 1.0, 1.0, front * h))
    return np.where(swap, 1.0 - value, value)


def student_t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper_tail(f, df1, df2):
    f, df1, df2 = np.asarray(f, float), np.asarray(df1, float), np.asarray(df2, float)
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * np.maximum(f, 0.0)))


def chi2_even_upper_tail(x, half_df):
    """Upper tail for 2*k degrees of freedom: a Poisson sum, added up in logs."""
    out = np.empty(len(x))
    for i, (xi, k) in enumerate(zip(x, half_df)):
        if np.isnan(xi) or np.isnan(k):
            out[i] = np.nan
            continue
        half = xi / 2.0
        if half <= 0:
            out[i] = 1.0
            continue
        terms = np.arange(int(k)) * math.log(half) - _lgamma(np.arange(int(k)) + 1.0)
        top = terms.max()
        out[i] = min(1.0, math.exp(top - half + math.log(np.exp(terms - top).sum())))
    return out


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2.0))


def mackinnon_p(tau: float) -> float:
    """Approximate Dickey-Fuller p-value, constant only, one series."""
    if tau > values.ADF_TAU_MAX:
        return 1.0
    if tau < values.ADF_TAU_MIN:
        return 0.0
    coefficients = values.ADF_SMALL_P if tau <= values.ADF_TAU_STAR else values.ADF_LARGE_P
    z = sum(c * tau ** i for i, c in enumerate(coefficients))
    return float(normal_cdf(z))


@F.pandas_udf(DOUBLE)
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    p = student_t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).where(t.notna() & df.notna())


@F.pandas_udf(DOUBLE)
def f_upper_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    p = f_upper_tail(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float))
    return pd.Series(p).where(f.notna())


@F.pandas_udf(DOUBLE)
def chi2_even_p(x: pd.Series, half_df: pd.Series) -> pd.Series:
    p = chi2_even_upper_tail(x.to_numpy(float), half_df.to_numpy(float))
    return pd.Series(p).where(x.notna() & half_df.notna())
