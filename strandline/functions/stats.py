"""Statistical functions as column expressions, and those that need iteration as pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanczos coefficients for g = 7, n = 9 (fixed values).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
#: Abramowitz and Stegun 7.1.26 (fixed values).
ERF_P = 0.3275911
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive arguments."""
    y = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + float(i))
    t = y + (LANCZOS_G + 0.5)
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def ln_choose(n: Column, k: Column) -> Column:
    """Logarithm of n over k; null where k is not within 0..n."""
    value = ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)
    return F.when((k >= 0) & (k <= n), value)


def hypergeometric_tail(k: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """Chance of at least k marked among ``drawn`` of ``total`` with ``marked`` marked.

    1 for k <= 0, 0 beyond what is possible. The first term comes from logarithms,
    each further one from the one before.
    """
    k, marked, drawn, total = (c.cast("double") for c in (k, marked, drawn, total))
    top, start = F.least(marked, drawn), F.greatest(k, drawn + marked - total)
    first = F.exp(ln_choose(marked, start) + ln_choose(total - marked, drawn - start) - ln_choose(total, drawn))
    ratio = lambda i: (marked - i) * (drawn - i) / ((i + 1.0) * (total - marked - drawn + i + 1.0))
    more = F.when(start < top, F.sequence(start.cast("int"), (top - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(
        more,
        F.struct(first.alias("sum"), first.alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"] * ratio(i)).alias("sum"), (a["term"] * ratio(i)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k <= 0, 1.0).when(k > top, 0.0).otherwise(F.least(tail, F.lit(1.0)))


def erfc(x: Column) -> Column:
    """Complementary error function to about 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * a)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + F.lit(c)) * t
    tail = poly * F.exp(-a * a)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal score."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi_square_tail(x: Column, df: int) -> Column:
    """Upper tail of chi-square: exact for 2, by the normal for 1, Wilson-Hilferty beyond."""
    if df == 1:
        return F.when(x > 0, erfc(F.sqrt(x / 2.0))).otherwise(1.0)
    if df == 2:
        return F.when(x > 0, F.exp(-x / 2.0)).otherwise(1.0)
    spread = 2.0 / (9.0 * df)
    z = (F.pow(x / float(df), F.lit(1.0 / 3.0)) - (1.0 - spread)) / math.sqrt(spread)
    return F.when(x > 0, 0.5 * erfc(z / math.sqrt(2.0))).otherwise(1.0)


def poisson_log10_tail(k: Column, rate: Column, cap: float = 300.0) -> Column:
    """-log10 of the chance of k or more at ``rate``: exact below 50, normal beyond, at most ``cap``; null for null."""
    below = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.least(k, F.lit(50)) - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + F.exp(i * F.log(rate) - rate - ln_gamma(i.cast("double") + 1.0))
    )
    # Above the rate the tail itself is summed, as one less the rest would cancel.
    above = F.aggregate(
        F.sequence(F.lit(1), F.lit(150)),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"] * rate / (k + j)).alias("sum"), (a["term"] * rate / (k + j)).alias("term")),
        lambda a: a["sum"],
    )
    exact = F.when(k > rate, above * F.exp(k * F.log(rate) - rate - ln_gamma(k.cast("double") + 1.0))).otherwise(1.0 - below)
    z = (k - 0.5 - rate) / F.sqrt(rate)
    tail = F.when(k < 50, exact).otherwise(0.5 * erfc(z / math.sqrt(2.0)))
    return F.when((k <= 0) | (rate <= 0), 0.0).when(k.isNotNull() & rate.isNotNull(), F.least(F.lit(cap), -F.log10(F.greatest(tail, F.lit(10.0**-cap)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 1e-12, dot(a, b) / norm).otherwise(0.0)


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, all at once."""
    gamma = np.vectorize(math.lgamma)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, h = np.ones_like(y), d.copy()
    for m in range(1, 200):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h *= c * d
    value = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; null where t or df is."""
    known = (t.notna() & df.notna() & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if known.any():
        x, n = t.to_numpy(float)[known], df.to_numpy(float)[known]
        out[known] = _incomplete_beta(n / 2, np.full(len(n), 0.5), n / (n + x * x))
    return pd.Series(out).where(known, None).astype("float64")
