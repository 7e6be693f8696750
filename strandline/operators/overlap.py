"""Joins and windows over genomic positions.

Spark has no range join: intervals meet by the bins they touch, and each pair is
kept in one bin only. Windows along a chromosome run in position blocks that carry
a margin of what follows, so a chromosome is never one task's work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.stats import poisson_log10_tail
from strandline.operators.intervals import BLOCK_WIDTH, periods_and_gaps
from strandline.operators.ordering import BLOCK_ROWS, _joined, in_blocks, numbered, running
from strandline.session import checkpoint_dir, checkpointed


def overlap_join(left: DataFrame, right: DataFrame, *, on: str = "chrom", left_span: tuple[str, str], right_span: tuple[str, str], bin_width: int = 1 << 17, how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals that overlap, each once.

    ``left_span`` and ``right_span`` name start and end; a point p is (p, p + 1).
    Columns must differ except ``on``. ``how`` is inner or left_anti.
    """
    (ls, le), (rs, re) = left_span, right_span
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width))
    b = right.select(F.col(on).alias("_on"), "*", F.explode(bins(rs, re)).alias("_rb")).drop(on)
    meets = lambda first: (F.col("_on") == F.col(on)) & (F.col("_rb") == F.col("_lb")) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & first
    once = F.col("_lb") == F.floor(F.greatest(ls, rs) / bin_width)
    a = left.withColumn("_lb", F.explode(bins(ls, le)))
    if how == "inner":
        return a.join(b, meets(once)).drop("_on", "_lb", "_rb")
    if how != "left_anti":
        raise ValueError(how)
    # A left row must miss in all of its bins.
    hits = a.join(b, meets(F.lit(True)), "left_semi").select(*left.columns).distinct()
    same = [left[c].eqNullSafe(hits[c]) for c in left.columns]
    return left.join(hits, same, "left_anti")


def spans_with_margin(df: DataFrame, *, position: str, margin: int, block_width: int = BLOCK_WIDTH) -> DataFrame:
    """Rows with their block (``_block``) and, if near the start of one, again as
    margin of the block before (``_own`` false)."""
    own = F.floor(F.col(position) / block_width)
    twice = F.when(F.col(position) - own * block_width < margin, F.array(own, own - 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(twice)).withColumn("_own", F.col("_block") == F.floor(F.col(position) / block_width))


def dense_islands(df: DataFrame, *, entity: list[str], position: str, span: int = 200, least: int = 5, ratio: float = 0.6, min_length: int = 200) -> DataFrame:
    """Stretches where sites lie dense.

    From each site, the sites within ``span`` are counted; where there are at least
    ``least``, and that many per 12.5 expected at least ``ratio``, the span is a
    seed. Overlapping seeds are one island. Result: entity, start_pos, end_pos.
    """
    sites = df.select(*entity, F.col(position).alias("_pos")).dropna().distinct()
    near = W.partitionBy(*entity, "_block").orderBy("_pos").rangeBetween(0, span - 1)
    counted = spans_with_margin(sites, position="_pos", margin=span).withColumn("_n", F.count("*").over(near)).filter("_own")
    seeds = counted.filter((F.col("_n") >= least) & (F.col("_n") / 12.5 >= ratio)).select(*entity, F.col("_pos").alias("start_pos"), (F.col("_pos") + span).alias("end_pos"))
    return periods_and_gaps(seeds, entity=entity).filter((F.col("kind") == "period") & (F.col("end_pos") - F.col("start_pos") >= min_length)).drop("kind")


def clustered_sites(df: DataFrame, *, entity: list[str], position: str, size: int = 6, mean_distance: float = 1000.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Regions in which sites crowd: runs of ``size`` neighbours whose distances have a
    geometric mean (of distance + 1) below ``mean_distance``; overlapping runs are one."""
    sites = df.select(*entity, F.col(position).alias("_pos")).dropna().distinct()
    placed = in_blocks(numbered(sites, entity, ["_pos"]), after=size - 1, size=block)
    along = W.partitionBy(*entity, "_b").orderBy("_i")
    with_gap = placed.withColumn("_g", F.log(F.col("_pos") - F.lag("_pos").over(along) + 1.0))
    frame = along.rowsBetween(1, size - 1)
    seeds = (
        with_gap.withColumn("_m", F.avg("_g").over(frame)).withColumn("_n", F.count("_g").over(frame)).withColumn("_last", F.last("_pos").over(frame))
        .filter(F.col("_own") & (F.col("_n") == size - 1) & (F.exp("_m") < mean_distance))
        .select(*entity, F.col("_pos").alias("start_pos"), (F.col("_last") + 1).alias("end_pos"))
    )
    return periods_and_gaps(seeds, entity=entity).filter(F.col("kind") == "period").drop("kind")


def sliding_regions(df: DataFrame, *, entity: list[str], order: list[str], value: Column, rows: int = 5, high: float = 80.0, low: float = 20.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Windows of exactly ``rows`` ordered sites whose mean is above ``high`` or below ``low``."""
    sites = df.withColumn("_v", value).filter(F.col("_v").isNotNull())
    frame = W.partitionBy(*entity, "_b").orderBy("_i").rowsBetween(0, rows - 1)
    windows = in_blocks(numbered(sites, entity, order), after=rows - 1, size=block)
    windows = windows.withColumn("_mean", F.avg("_v").over(frame)).withColumn("_n", F.count("_v").over(frame)).withColumn("end_pos", F.last(order[0]).over(frame))
    kind = F.when(F.col("_mean") > high, "hyper").when(F.col("_mean") < low, "hypo")
    return windows.filter(F.col("_own") & (F.col("_n") == rows)).withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*entity, F.col(order[0]).alias("start_pos"), "end_pos", "kind", F.round("_mean", 5).alias("mean"))


def change_points(df: DataFrame, *, entity: list[str], order: list[str], value: str, step: float = 0.3, block: int = BLOCK_ROWS) -> DataFrame:
    """Rolling mean over five rows, centred, and segments that begin where it jumps by more than ``step``."""
    along = W.partitionBy(*entity, "_b").orderBy("_i")
    placed = in_blocks(numbered(df, entity, order), before=3, after=2, size=block)
    smooth = placed.withColumn("_mean", F.avg(F.col(value).cast("double")).over(along.rowsBetween(-2, 2)))
    jump = F.coalesce(F.abs(F.col("_mean") - F.lag("_mean").over(along)) > step, F.lit(True))
    # The last row before a block and the first one of an entity have no row before them here, only there.
    flagged = smooth.withColumn("_new", jump.cast("int")).filter("_own").drop("_b", "_own")
    segments = running(flagged, entity, F.col("_new"), "segment_no")
    return segments.groupBy(*entity, "segment_no").agg(F.count("*").alias("n_rows"), F.min(order[0]).alias("first_pos"), F.max(order[0]).alias("last_pos"), F.round(F.avg("_mean"), 5).alias("level"))


def merge_keeping_best(df: DataFrame, *, entity: list[str], start: str, end: str, best: str, keep: list[str]) -> DataFrame:
    """Overlapping or touching intervals as one, with the ``keep`` columns of the row
    that has the highest ``best`` (of equal ones the first) and its count."""
    rows = running(numbered(df, entity, [start, end]), entity, F.col(end), "_before", F.max, inclusive=False)
    flagged = rows.withColumn("_new", F.coalesce(F.col(start) > F.col("_before"), F.lit(True)).cast("int"))
    grouped = running(flagged, entity, F.col("_new"), "_g")
    merged = grouped.groupBy(*entity, "_g").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"), F.max(F.struct(F.col(best), -F.col(start), *[F.col(c) for c in keep])).alias("_x")
    )
    return merged.select(*entity, start, end, "n_merged", F.col(f"_x.{best}").alias(best), *[F.col(f"_x.{c}").alias(c) for c in keep])


def deepest_stack(df: DataFrame, *, entity: list[str], start: str, end: str) -> DataFrame:
    """The largest number of intervals over one point, per entity (``deepest``), by the
    running sum of starts and ends."""
    ends = df.select(*entity, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("_x"))
    steps = ends.groupBy(*entity, F.col("_x.at").alias("_at")).agg(F.sum("_x.d").alias("_d"))
    depth = running(numbered(steps, entity, ["_at"]), entity, F.col("_d"), "_depth")
    return depth.groupBy(*entity).agg(F.max("_depth").alias("deepest"))


def area_under(df: DataFrame, *, entity: list[str], order: list[str], x: Column, y: Column, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows and area (trapezoids) under y over x per entity, in the order."""
    rows = in_blocks(numbered(df.withColumn("_x", x).withColumn("_y", y), entity, order), before=1, size=block)
    along = W.partitionBy(*entity, "_b").orderBy("_i")
    part = (F.col("_y") + F.lag("_y").over(along)) / 2 * (F.col("_x") - F.lag("_x").over(along))
    return rows.withColumn("_a", part).filter("_own").groupBy(*entity).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def filled_bins(df: DataFrame, *, entity: str, position: str, width: int) -> DataFrame:
    """Rows per (entity, bin of ``width``), bins without rows up to the last one included."""
    counted = df.groupBy(entity, F.floor(F.col(position) / width).alias("bin")).agg(F.count("*").alias("n_rows"))
    all_bins = counted.groupBy(entity).agg(F.max("bin").alias("_last")).select(entity, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("bin"))
    return all_bins.join(counted, [entity, "bin"], "left").select(entity, "bin", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def call_peaks(tags: DataFrame, lengths: DataFrame, *, start: str, is_reverse: Column, shift: int = 0, extend: int = 200, least: float = 5.0, window: int = 200) -> DataFrame:
    """Peaks where tags crowd: windows of ``window`` bases, half a window apart, whose
    coverage has a Poisson score (-log10 of the tail) above ``least``.

    ``tags``: chrom and 0-based ``start``; each is shifted along its strand, extended
    and cut at the chromosome's ends (``lengths``: chrom, length). Coverage counts in
    bins of half a window, so a base adds one to two windows and no base is a row.
    The rate is that of the tags over all bases, a window wide. Windows next to each
    other are one peak, which ends with the first window that fails (or with the
    chromosome); peaks that overlap or touch are one. Result: chrom, start_pos, end_pos, summit
    (start of the best window), height, score, fold.
    """
    half = window // 2
    placed = tags.select("chrom", (F.col(start) + F.when(is_reverse, -shift).otherwise(shift)).alias("_at")).join(lengths, "chrom")
    begin = F.greatest("_at", F.lit(0))
    spans = placed.select("chrom", "length", begin.alias("_b"), F.least(F.greatest(F.col("_at") + extend, begin + 1), F.col("length")).alias("_e")).filter("_b < _e")
    rate = spans.agg(F.count("*").alias("_tags")).crossJoin(lengths.agg(F.sum("length").alias("_all"))).select((F.col("_tags") / F.col("_all") * window).alias("_rate"))
    bins = spans.select("chrom", "length", "_b", "_e", F.explode(F.sequence(F.floor(F.col("_b") / half), F.floor((F.col("_e") - 1) / half))).alias("_k"))
    bases = F.least("_e", (F.col("_k") + 1) * half) - F.greatest("_b", F.col("_k") * half)
    covered = bins.groupBy("chrom", "length", "_k").agg(F.sum(bases).alias("_n"))
    sums = covered.withColumn("_w", F.explode(F.array("_k", F.col("_k") - 1))).filter((F.col("_w") >= 0) & (F.col("_w") * half + window <= F.col("length"))).groupBy("chrom", "length", "_w").agg(F.sum("_n").alias("_n"))
    scored = sums.crossJoin(rate).withColumn("_score", poisson_log10_tail(F.col("_n"), F.col("_rate"))).filter(F.col("_score") > least)
    steps = scored.select("chrom", "length", F.col("_w").alias("_from"), (F.col("_w") + 1).alias("_to"), F.col("_n").alias("height"), F.col("_w").alias("_best"), F.col("_score").alias("score"), (F.col("_n") / F.col("_rate")).alias("fold"))
    keep = ["_best", "score", "fold", "length"]
    runs = merge_keeping_best(steps, entity=["chrom"], start="_from", end="_to", best="height", keep=keep)
    last = F.floor((F.col("length") - window) / half)
    ends = F.when(F.col("_to") > last, F.col("length")).otherwise(F.col("_to") * half + window)
    peaks = runs.select("chrom", (F.col("_from") * half).alias("start_pos"), ends.alias("end_pos"), (F.col("_best") * half).alias("summit"), "height", "score", "fold")
    return merge_keeping_best(peaks, entity=["chrom"], start="start_pos", end="end_pos", best="height", keep=["summit", "score", "fold"]).drop("n_merged")


def _merge_pass(rows: DataFrame, entity: list[str], least: int) -> DataFrame:
    """One pass of ``merge_small`` over entities of any size."""
    placed = numbered(rows, entity, ["_s", "_f"])
    small = F.coalesce(F.col("_n") < least, F.lit(False))
    # A small segment's place in its row of small ones: its number less that of the last large one.
    with_last = running(placed, entity, F.when(~small, F.col("_i")), "_large", F.max)
    place = F.col("_i") - F.coalesce("_large", F.lit(-1)) - 1
    both = in_blocks(with_last.withColumn("_takes", small & (place % 2 == 0)), before=1, after=1)
    along = W.partitionBy(*entity, "_b").orderBy("_i")
    ahead, behind = F.lead("_i").over(along).isNotNull(), F.coalesce(F.lag("_takes").over(along), F.lit(False))
    opens = ~behind & (ahead | ~small | (F.col("_i") == 0))
    flagged = both.withColumn("_open", opens.cast("int")).filter("_own").drop("_b", "_own")
    return running(flagged, entity, F.col("_open"), "_g").groupBy(*entity, "_g").agg(F.min("_s").alias("_s"), F.max("_f").alias("_f"), F.sum("_n").alias("_n")).drop("_g")


def _merged_places(first: np.ndarray, n: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
    """The segment each row ends up in after all passes; ``first``: where an entity
    begins, ``known``: where there is a size (a segment without one is not small)."""
    of = np.arange(len(n))
    while True:
        at, small = np.arange(len(n)), (n < least) & known
        start = np.maximum.accumulate(np.where(first, at, 0))
        large = np.maximum(np.maximum.accumulate(np.where(small, -1, at)), start - 1)
        takes = small & ((at - large - 1) % 2 == 0)
        last = np.append(first[1:], True)
        opens = first | (~np.append(False, takes[:-1]) & (~last | ~small))
        if opens.all():
            return of
        of = (np.cumsum(opens) - 1)[of]
        n, known, first = np.add.reduceat(n, np.flatnonzero(opens)), np.logical_or.reduceat(known, np.flatnonzero(opens)), first[opens]


def _merge_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, ``_r`` 1 where an entity begins, with the segment ``_g`` of their entity instead."""

    def settled(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        sizes = rows.column("_n")
        groups = _merged_places(rows.column("_r").to_numpy() == 1, sizes.fill_null(0).to_numpy(), sizes.is_valid().to_numpy(), least)
        return rows.drop_columns(["_r"]).append_column("_g", pa.array(groups, pa.int64())).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        begun = np.flatnonzero(batch.column("_r").to_numpy(zero_copy_only=False) == 1)
        if not len(begun):
            held.append(batch)
            continue
        # What an entity still lacks comes with the next batch.
        if held or begun[-1]:
            yield from settled([*held, batch.slice(0, int(begun[-1]))])
        held = [batch.slice(int(begun[-1]))]
    if sum(len(b) for b in held):
        yield from settled(held)


def _without(rows: DataFrame, entities: DataFrame, on: list[str]) -> DataFrame:
    """Rows of all other entities; nulls match."""
    renamed = entities.select(*[F.col(c).alias(f"_on_{c}") for c in on])
    return rows.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]), "left_anti")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, with its own size as its only statistics."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def merge_small(df: DataFrame, *, entity: list[str], start: str, end: str, size: str, least: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Segments in order of ``start``, those of a ``size`` below ``least`` merged until none is left.

    In each pass, from the left, a small segment takes in the next one, whatever that
    is, and the last one of its entity goes to the one before it. So of small
    segments in a row the first, third, ... take in their neighbours: a pass is a
    matter of places in such rows, and its groups are running sums. An entity that is
    small as a whole stays one segment. Result: entity, ``start``, ``end``, ``size``.

    An entity of up to ``block`` rows goes through all its passes in one task. Larger
    ones go through passes in blocks until they have no more rows than that, each
    written as a table: a checkpoint keeps the estimated size of the joins before it,
    a product of products that takes the driver's memory after some passes.
    """
    rows = _written(df.select(*entity, F.col(start).alias("_s"), F.col(end).alias("_f"), F.col(size).cast("long").alias("_n")), "segments")
    within, done = [], []
    while True:
        sizes = checkpointed(rows.groupBy(*entity).agg(F.count("*").alias("_rows"), F.count(F.when(F.col("_n") < least, 1)).alias("_small")).filter(F.col("_rows") > block))
        if sizes.isEmpty():
            within.append(rows)
            break
        wide = _joined(rows, sizes, entity)
        done.append(wide.filter("_small = 0").select(rows.columns))
        within.append(_without(rows, sizes, entity))
        rows = _written(_merge_pass(wide.filter("_small > 0").select(rows.columns), entity, least), "segments")
    placed = reduce(DataFrame.unionByName, within).withColumn("_r", F.row_number().over(W.partitionBy(*entity).orderBy("_s", "_f")))
    schema = T.StructType([*(f for f in placed.schema if f.name != "_r"), T.StructField("_g", T.LongType())])
    merged = placed.mapInArrow(partial(_merge_rows, least=least), schema).groupBy(*entity, "_g").agg(F.min("_s").alias("_s"), F.max("_f").alias("_f"), F.sum("_n").alias("_n")).drop("_g")
    return reduce(DataFrame.unionByName, [merged, *done]).select(*entity, F.col("_s").alias(start), F.col("_f").alias(end), F.col("_n").alias(size))
