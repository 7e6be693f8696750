"""Traces of ions over time: areas, library scores, votes of fragments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.peptides import fragment_ions
from strandline.session import checkpointed, shuffle_partitions

#: Peptides of a class that one task joins with its spectra.
MEMBERS = 100


def _in_window(targets: DataFrame, spectra: DataFrame, window: float) -> DataFrame:
    """Targets (``rt``) with the spectra (``_rt``) at most ``window`` seconds away: a join on bins of that width."""
    bins = F.sequence(F.floor((F.col("rt") - window) / window), F.floor((F.col("rt") + window) / window))
    near = targets.withColumn("_bin", F.explode(bins)).join(spectra.withColumn("_bin", F.floor(F.col("_rt") / window)), "_bin").drop("_bin")
    return near.filter(F.abs(F.col("_rt") - F.col("rt")) <= window)


def _slim(spectra: DataFrame) -> DataFrame:
    return spectra.select(F.col("scan").alias("_scan"), F.col("rt").alias("_rt"), F.arrays_zip(F.col("mz").cast("array<double>").alias("m"), F.col("intensity").cast("array<double>").alias("i")).alias("_peaks"))


def _within(peaks: Column, mz: Column, ppm: float) -> Column:
    return F.transform(F.filter(peaks, lambda p: F.abs(p["m"] - mz) <= mz * ppm / 1e6), lambda p: p["i"])


def ion_areas(spectra: DataFrame, targets: DataFrame, *, key: str, window: float = 30.0, ppm: float = 5.0) -> DataFrame:
    """Area under each target's trace and its points: ``key``, ``n_points``, ``area``.

    ``spectra``: scan, rt, mz, intensity (arrays); ``targets``: ``key``, mz, rt. A
    point is the intensity within ``ppm`` of the target in a scan at most ``window``
    seconds away, 0 where there is none; areas are trapezoids, and a single point's
    intensity stands for itself. Targets without a scan give no row.
    """
    met = _in_window(targets.select(key, F.col("mz").alias("_mz"), "rt"), _slim(spectra), window)
    points = met.select(key, "_scan", "_rt", F.aggregate(_within(F.col("_peaks"), F.col("_mz"), ppm), F.lit(0.0), lambda a, i: a + i).alias("_i"))
    along = W.partitionBy(key).orderBy("_rt", "_scan")
    parts = points.withColumn("_a", (F.col("_i") + F.lag("_i").over(along)) / 2 * (F.col("_rt") - F.lag("_rt").over(along)))
    return parts.groupBy(key).agg(F.count("*").alias("n_points"), F.coalesce(F.sum("_a"), F.max("_i")).alias("area"))


def _window_sums(asked: np.ndarray, rt: np.ndarray, scan: np.ndarray, at: np.ndarray, value: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each time asked for that has points in its window: the time, that of the scan that shows most, each fragment's sum."""
    order = np.lexsort((scan, rt))
    rt, scan, at, value = rt[order], scan[order], at[order], value[order]
    new = np.append(True, (rt[1:] != rt[:-1]) | (scan[1:] != scan[:-1]))
    times, row = rt[new], np.cumsum(new) - 1
    shown = np.zeros((len(times), at.max() + 1))
    shown[row, at] = value
    low, high = np.searchsorted(times, asked - window), np.searchsorted(times, asked + window, "right")
    asked, low, high = asked[high > low], low[high > low], high[high > low]
    total = shown.sum(axis=1)
    if not len(asked):
        return asked, asked, []
    if not np.isfinite(shown).all():
        sums = [shown[a:b].sum(axis=0) for a, b in zip(low, high)]
        best = np.array([a + np.argmax(total[a:b]) for a, b in zip(low, high)])
    else:
        upto = np.concatenate((np.zeros((1, shown.shape[1]), np.longdouble), np.cumsum(shown, axis=0, dtype=np.longdouble)))
        some = np.concatenate((np.zeros((1, shown.shape[1]), np.int64), np.cumsum(shown != 0, axis=0)))
        sums = list(np.where(some[high] > some[low], upto[high] - upto[low], 0).astype(float))
        # First of the highest over any span: of two spans of a power of two that cover it.
        tops, step = [np.arange(len(times))], 1
        while 2 * step <= len(times):
            a, b = tops[-1][:-step], tops[-1][step:]
            tops.append(np.where(total[b] > total[a], b, a))
            step *= 2
        level = np.frexp((high - low).astype(float))[1] - 1
        best = np.empty(len(asked), np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            a, b = tops[k][low[of]], tops[k][high[of] - (1 << int(k))]
            best[of] = np.where(total[b] > total[a], b, a)
    return asked, np.where(total[best] <= 0, asked, times[best]), sums


_SUMS = T.StructType([T.StructField("_class", T.LongType()), T.StructField("rt", T.DoubleType()), T.StructField("rt_best", T.DoubleType()), T.StructField("_x", T.ArrayType(T.DoubleType()))])


def _traced(batches: Iterator[pa.RecordBatch], window: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and bin, times asked for (``_at`` -1) and points, to the sums of each time asked for."""

    def summed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in parts[0].schema.names}
        kind, place = columns["_class"], columns["_bin"]
        edges = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (place[1:] != place[:-1])))
        classes, times, best, sums = [], [], [], []
        for a, b in zip(edges, np.append(edges[1:], len(kind))):
            at, rt = columns["_at"][a:b], columns["_rt"][a:b]
            asked, points = at < 0, at >= 0
            if not asked.any() or not points.any():
                continue
            t, m, x = _window_sums(rt[asked], rt[points], columns["_scan"][a:b][points], at[points], columns["_i"][a:b][points], window)
            classes.append(np.full(len(t), kind[a]))
            times.append(t)
            best.append(m)
            sums += x
        if classes:
            for n, x in enumerate(np.split(np.arange(len(sums)), range(10_000, len(sums), 10_000))):
                part = slice(n * 10_000, n * 10_000 + len(x))
                arrays = [np.concatenate(classes)[part], np.concatenate(times)[part], np.concatenate(best)[part], pa.array(sums[part], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=_SUMS.names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        kind, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_class", "_bin"))
        # The last group may go on in the next batch.
        cut = int(np.flatnonzero((kind != kind[-1]) | (place != place[-1]))[-1]) + 1 if (kind[0], place[0]) != (kind[-1], place[-1]) else 0
        if not cut and held and (held[-1].column("_class")[-1].as_py(), held[-1].column("_bin")[-1].as_py()) == (int(kind[0]), int(place[0])):
            held.append(batch)
            continue
        yield from summed([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield from summed(held)


def library_scores(spectra: DataFrame, library: DataFrame, *, key: str, ppm: float = 20.0, window: float = 60.0, sigma: float = 30.0, least_fragments: int = 3, least_score: float = 0.5) -> DataFrame:
    """Library entries that the fragment spectra show.

    ``library``: ``key``, rt, fragments (array of mz, intensity). Each fragment's
    trace is summed over the scans within ``window``, its highest peak within ``ppm``
    a scan; the score is the cosine of library and sums, times exp(-(d / sigma)²) of
    the distance to the scan that shows most, at least 0.01. Result: ``key``,
    ``rt_best``, ``n_fragments``, ``score``.

    A trace is worked out once for all entries that share fragments and a bin of
    time, from the peaks of the bins around it that meet one of its masses; entries
    take their window's sums and top from running figures of the trace, so an entry
    costs no row for each scan.
    """
    entries = library.select(key, F.col("rt").cast("double").alias("rt"), F.transform("fragments", lambda f: F.struct(f["mz"].cast("double").alias("mz"), f["intensity"].cast("double").alias("lib"))).alias("_fragments")).filter("rt IS NOT NULL")
    kinds = checkpointed(entries.select("_fragments").distinct().withColumn("_class", F.monotonically_increasing_id()))
    placed = checkpointed(entries.join(kinds, "_fragments").select(key, "rt", "_class", F.floor(F.col("rt") / window).alias("_bin")))
    asked = placed.select("_class", "_bin", "rt").distinct()

    # Masses asked for in each bin of scans; masses meet in bins of twice their tolerance.
    step = 2 * ppm / 1e6
    groups = asked.select("_class", "_bin").distinct().withColumn("_near", F.explode(F.sequence(F.col("_bin") - 1, F.col("_bin") + 1)))
    wanted = groups.join(kinds, "_class").select("_class", "_bin", "_near", F.posexplode("_fragments").alias("_at", "_f")).select("_class", "_bin", "_near", "_at", F.col("_f.mz").alias("_mz"))
    slack = F.col("_mz") * ppm / 1e6
    cells = F.sequence(F.floor(F.ln(F.col("_mz") - slack) / step), F.floor(F.ln(F.col("_mz") + slack) / step))
    masses = wanted.select("_near", "_mz").distinct().withColumn("_cell", F.explode(cells))
    scans = spectra.select(F.col("scan").cast("long").alias("_scan"), F.col("rt").cast("double").alias("_rt"), "mz", "intensity").withColumn("_near", F.floor(F.col("_rt") / window))
    needed = scans.join(groups.select("_near").distinct(), "_near", "left_semi")
    peaks = needed.select("_near", "_scan", "_rt", F.explode(F.arrays_zip(F.col("mz").cast("array<double>").alias("m"), F.col("intensity").cast("array<double>").alias("i"))).alias("_p"))
    peaks = peaks.groupBy("_near", "_scan", "_rt", F.col("_p.m").alias("_m")).agg(F.max("_p.i").alias("_i")).withColumn("_cell", F.floor(F.ln("_m") / step))
    met = peaks.join(masses, ["_near", "_cell"]).filter(F.abs(F.col("_m") - F.col("_mz")) <= slack)
    points = met.groupBy("_near", "_mz", "_scan", "_rt").agg(F.max("_i").alias("_i")).filter("_i IS NOT NULL")

    rows = points.join(wanted, ["_near", "_mz"]).select("_class", "_bin", "_at", "_rt", "_scan", "_i")
    times = asked.select("_class", "_bin", F.lit(-1).alias("_at"), F.col("rt").alias("_rt"), F.lit(0).cast("long").alias("_scan"), F.lit(0.0).alias("_i"))
    sorted_ = rows.unionByName(times).repartition(shuffle_partitions(spectra.sparkSession), "_class", "_bin").sortWithinPartitions("_class", "_bin")
    sums = sorted_.mapInArrow(partial(_traced, window=window), _SUMS)

    # Fragments beyond the last one that was met have no sum.
    both = sums.join(kinds, "_class").withColumn("_z", F.arrays_zip("_fragments", "_x"))
    total = lambda f: F.aggregate("_z", F.lit(0.0), lambda a, z: a + F.coalesce(f(z["_fragments"]["lib"], F.coalesce(z["_x"], F.lit(0.0))), F.lit(0.0)))
    norm = F.sqrt(total(lambda lib, x: lib * lib) * total(lambda lib, x: x * x))
    rated = both.select("_class", "rt", "rt_best", F.size(F.filter("_x", lambda x: x > 0)).cast("long").alias("n_fragments"), F.try_divide(total(lambda lib, x: lib * x), norm).alias("_dot"))
    kept = rated.filter((F.col("n_fragments") >= least_fragments) & (F.col("_dot") >= least_score)).join(placed.drop("_bin"), ["_class", "rt"])
    away = (F.col("rt_best") - F.col("rt")) / sigma
    return kept.select(key, "rt_best", "n_fragments", (F.col("_dot") * F.greatest(F.exp(-away * away), F.lit(0.01))).alias("score"))


def library_entries(matches: DataFrame, *, most: float = 0.01, ions: int = 6) -> DataFrame:
    """A library from matches (peptide, rt, is_decoy, q_value): the first ``ions`` b ions at
    one half and y ions at one, of matches that are no decoys and pass ``most``."""
    b, y = fragment_ions(F.col("peptide"))
    peaks = lambda side, height: F.transform(F.slice(side, 1, ions), lambda m: F.struct(m.alias("mz"), F.lit(height).alias("intensity")))
    kept = matches.filter(~F.col("is_decoy") & (F.col("q_value") <= most))
    return kept.select("peptide", "rt", F.concat(peaks(b, 0.5), peaks(y, 1.0)).alias("fragments"))


def voted_candidates(spectra: DataFrame, peptides: DataFrame, *, spectrum: str, peptide: str, ppm: float = 10.0, least: float = 0.05, votes: int = 2, width: float = 1.0) -> DataFrame:
    """Peptides of a fitting mass that at least ``votes`` peaks point to.

    ``spectra``: ``spectrum``, neutral_mass, mz (array); ``peptides``: ``peptide``,
    mass, ions (array). Masses meet in whole daltons, then within ``ppm`` or
    ``least``; fragments are whole daltons too, and a peak votes for every ion within
    a dalton's bins around it. Result: ``spectrum``, ``peptide``, ``votes``.

    A spectrum's votes for each dalton are counted once, and looked up by the ions of
    every class of peptides that share masses and ions; peaks are not laid out for
    each pair. The pairs themselves are only written as the result.
    """
    masses, ions = F.sort_array(F.collect_list("mass")).alias("_masses"), F.sort_array(F.flatten(F.collect_list(F.transform("ions", lambda m: F.floor(m))))).alias("_ions")
    known = peptides.filter(F.col(peptide).isNotNull()).groupBy(peptide).agg(masses, ions)
    classes = known.groupBy("_masses", "_ions").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_parts"))

    peaks = spectra.repartition(spectrum, "neutral_mass").select(spectrum, "neutral_mass", F.explode("mz").alias("_mz"))
    near = peaks.select(spectrum, "neutral_mass", F.explode(F.sequence(F.floor(F.col("_mz") - width), F.floor(F.col("_mz") + width))).alias("_ion"))
    counted = near.groupBy(spectrum, "neutral_mass", "_ion").agg(F.count("*").alias("_n")).groupBy(spectrum, "neutral_mass").agg(F.map_from_entries(F.collect_list(F.struct("_ion", "_n"))).alias("_votes"))
    slack = F.greatest(F.col("neutral_mass") * ppm / 1e6, F.lit(least))
    wide = counted.select("*", F.explode(F.sequence(F.floor(F.col("neutral_mass") - slack), F.floor(F.col("neutral_mass") + slack))).alias("_bin"))
    fits = wide.join(classes.select("*", F.explode("_masses").alias("_mass")).withColumn("_bin", F.floor("_mass")), "_bin").filter(F.abs(F.col("_mass") - F.col("neutral_mass")) <= slack)
    given = F.aggregate("_ions", F.lit(0).cast("long"), lambda n, ion: n + F.coalesce(F.col("_votes")[ion], F.lit(0)))
    pairs = fits.select(spectrum, "_masses", "_ions", "_parts", given.alias("_v")).groupBy(spectrum, "_masses", "_ions", "_parts").agg(F.sum("_v").alias("votes")).filter(F.col("votes") >= votes)

    # Classes of many peptides are dealt over several tasks, however small the tables are that make so many pairs.
    width_ = shuffle_partitions(spectra.sparkSession)
    dealt = pairs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(width_, "_masses", "_ions", "_part")
    members = known.join(classes, ["_masses", "_ions"]).withColumn("_part", F.pmod(F.xxhash64(peptide), F.col("_parts")).cast("int")).drop("_parts").repartition(width_, "_masses", "_ions", "_part")
    return dealt.join(members, ["_masses", "_ions", "_part"]).select(spectrum, peptide, "votes")
