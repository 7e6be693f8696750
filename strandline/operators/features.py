"""Features of LC-MS runs: isotope groups, traces over time, their bounds, and distinct ones.

Greedy passes over sorted peaks become gaps in orders: a trace ends where the next
mass or the next time lies too far away, whatever came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.ordering import BLOCK_ROWS, in_blocks, numbered, running

#: Distance of isotopes in daltons, times the charge (fixed value).
ISOTOPE = 1.00335


def isotope_groups(spectra: DataFrame, *, ppm: float = 20.0, charges: tuple[int, ...] = (1, 2, 3, 4), most: int = 4) -> DataFrame:
    """Peaks that begin an isotope pattern: scan, rt, mz, intensity, ``charge``, ``n_isotopes``.

    For each charge, the peaks at one, two, ... isotope distances above are counted
    up to ``most`` with the first; the charge with the longest pattern counts (of
    equal ones the lowest), if it has two peaks or more and none lies below the
    first. ``spectra``: scan, rt, mz, intensity (arrays); a scan's peaks meet each
    other only.
    """
    peaks = F.arrays_zip(F.col("mz").cast("array<double>").alias("m"), F.col("intensity").cast("array<double>").alias("i"))
    rows = spectra.select("scan", "rt", peaks.alias("_p"), F.explode(peaks).alias("_x")).select("scan", "rt", "_p", F.col("_x.m").alias("mz"), F.col("_x.i").alias("intensity"))
    at = lambda m: F.exists("_p", lambda q: F.abs(q["m"] - m) <= m * ppm / 1e6)

    def length(z: int) -> Column:
        n = F.lit(1)
        for step in range(most - 1, 0, -1):
            n = F.when(at(F.col("mz") + step * ISOTOPE / z), n + 1).otherwise(1)
        return n

    patterns = F.array(*[F.struct(length(z).alias("n"), F.lit(-z).alias("z"), at(F.col("mz") - ISOTOPE / z).alias("below")) for z in charges])
    best = rows.withColumn("_b", F.array_max(patterns)).filter((F.col("_b.n") >= 2) & ~F.col("_b.below"))
    return best.select("scan", "rt", "mz", "intensity", (-F.col("_b.z")).alias("charge"), F.col("_b.n").alias("n_isotopes"))


def ion_traces(peaks: DataFrame, *, ppm: float = 10.0, most_apart: float = 30.0) -> DataFrame:
    """Peaks (scan, rt, mz, intensity) with their trace: ``band`` and ``trace`` number.

    In the order of masses a band ends where the next mass is more than ``ppm``
    higher; in a band's order of times a trace ends where the next peak is more than
    ``most_apart`` seconds later.
    """
    along = W.partitionBy("_b").orderBy("_i")
    by_mass = in_blocks(numbered(peaks, [], ["mz", "rt", "scan"]), before=1, size=BLOCK_ROWS)
    step = F.coalesce(F.col("mz") - F.lag("mz").over(along) > F.col("mz") * ppm / 1e6, F.lit(True))
    banded = running(by_mass.withColumn("_new", step.cast("int")).filter("_own").drop("_b", "_own"), [], F.col("_new"), "band").drop("_new", "_i")
    in_band = W.partitionBy("band", "_b").orderBy("_i")
    by_time = in_blocks(numbered(banded, ["band"], ["rt", "scan", "mz", "intensity"]), before=1, size=BLOCK_ROWS)
    apart = F.coalesce(F.col("rt") - F.lag("rt").over(in_band) > most_apart, F.lit(True))
    return running(by_time.withColumn("_new", apart.cast("int")).filter("_own").drop("_b", "_own"), ["band"], F.col("_new"), "trace").drop("_new", "_i")


def trace_features(traces: DataFrame, *, least_points: int = 3) -> DataFrame:
    """Features of traces whose highest peak is not at an end: band, trace, ``mz`` (mean),
    ``apex`` (time; of equal ones the first), ``height``, ``since`` and ``until`` (the
    nearest times on both sides at which the trace is below half the height, or its
    ends) and ``n_points``."""
    key = ["band", "trace"]
    tops = traces.groupBy(*key).agg(F.count("*").alias("n_points"), F.avg("mz").alias("mz"), F.min("rt").alias("_first"), F.max("rt").alias("_last"), F.max(F.struct("intensity", -F.col("rt"))).alias("_t"))
    tops = tops.select(*key, "n_points", "mz", "_first", "_last", F.col("_t.intensity").alias("height"), (-F.col("_t.col2")).alias("apex"))
    kept = tops.filter((F.col("n_points") >= least_points) & (F.col("apex") > F.col("_first")) & (F.col("apex") < F.col("_last")))
    low = traces.join(kept.select(*key, "height", "apex"), key).filter(F.col("intensity") < F.col("height") / 2)
    sides = low.groupBy(*key).agg(F.max(F.when(F.col("rt") < F.col("apex"), F.col("rt"))).alias("_a"), F.min(F.when(F.col("rt") > F.col("apex"), F.col("rt"))).alias("_b"))
    joined = kept.join(sides, key, "left")
    return joined.select(*key, "mz", "apex", "height", F.coalesce("_a", "_first").alias("since"), F.coalesce("_b", "_last").alias("until"), "n_points")


def distinct_features(found: DataFrame, *, ppm: float = 5.0) -> DataFrame:
    """Features that no higher one covers: none within ``ppm`` that overlaps in time and is
    higher (of equal height earlier, then lower in mass). A join on mass bins of one hundredth."""
    width = 0.01
    bins = lambda m: F.sequence(F.floor((m - m * ppm / 1e6) / width), F.floor((m + m * ppm / 1e6) / width))
    own = found.withColumn("_bin", F.explode(bins(F.col("mz"))))
    other = found.select(*[F.col(c).alias(f"_{c}") for c in ("mz", "apex", "height", "since", "until")], F.floor(F.col("mz") / width).alias("_bin"))
    higher = (F.col("_height") > F.col("height")) | ((F.col("_height") == F.col("height")) & ((F.col("_apex") < F.col("apex")) | ((F.col("_apex") == F.col("apex")) & (F.col("_mz") < F.col("mz")))))
    covered = own.join(other, "_bin").filter((F.abs(F.col("_mz") - F.col("mz")) <= F.col("mz") * ppm / 1e6) & (F.col("_since") <= F.col("until")) & (F.col("since") <= F.col("_until")) & higher)
    return found.join(covered.select("band", "trace").distinct(), ["band", "trace"], "left_anti")


def feature_report(found: DataFrame) -> DataFrame:
    """One row: features, median mass, first and last apex, highest."""
    return found.agg(F.count("*").alias("n_features"), F.expr("percentile(mz, 0.5)").alias("median_mz"), F.min("apex").alias("first"), F.max("apex").alias("last"), F.max("height").alias("highest"))
