"""Percentiles with bounded error from sketches that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the compactors. The rank error of a quantile is about 0.13 % of the rows
#: with 99 % probability at 4096 (about 2.296 / k ** 0.9021, one quantile), and a
#: group of up to k values is exact.
COMPACTOR = 4096


def rank_error(k: int = COMPACTOR) -> float:
    """The bound of the rank error of one quantile, at 99 % (published for this sketch)."""
    return 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, *, dims: list[str], value: Column | str, k: int = COMPACTOR) -> DataFrame:
    """One sketch per group: dims, ``sketch`` (binary), ``n``.

    The sketch is a hierarchy of randomised compactors that sort and keep alternate
    values. Partial sketches are built on the map side and merged level by level,
    so a hot group is never gathered in one task. Nulls, NaN and infinities are
    left out; groups without values give no row; ties and repeats count each.
    """
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    finite = df.select(*dims, number.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    return finite.groupBy(*dims).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, dims: list[str], k: int = COMPACTOR) -> DataFrame:
    """Sketches over fewer dimensions, or of several loads together."""
    return sketches.groupBy(*dims).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantile(q: float) -> Column:
    """The q-quantile of a sketch row; between two values, their mean.

    Of n sorted values it is the mean of those at 1-based places ceil(q n) and
    floor(q n) + 1: the usual median for q = 0.5, and otherwise the value that
    the inverse distribution function gives, averaged where it jumps. (The second
    place is asked for as a rank one part in 10^6 higher, which the error bound of
    the sketch dwarfs where it is more than one place.)
    """
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank)))
    return (at(q) + at(min(q + 1e-6, 1.0))) / 2
