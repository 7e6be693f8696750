"""Runs of identical or nearly identical consecutive events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.session import shuffle_partitions


def collapse_runs(
    df: DataFrame,
    *,
    entity: str,
    time: str,
    key: str,
    label: Column | str,
    position: Column | str,
    tolerance: int,
    least: int = 1,
    blocks: int | None = None,
) -> DataFrame:
    """Each run of (nearly) the same event of an entity as one row, with count and duration.

    The events of an entity are ordered by ``time``, then ``key``. A run is a
    maximal series of events following each other directly, each with the label
    of the one before and a position at most ``tolerance`` away from it; runs of
    at least ``least`` events come out.

    Method: events are canonicalised to (label, island), an island being
    positions of one label that lie at most ``tolerance`` apart from neighbour to
    neighbour; where the row number within the entity less the row number within
    entity and canonical event stays the same, the events follow each other
    directly. Inside such a run, each single step is then checked exactly.

    The order is cut into ``blocks`` equal ranges (the shuffle width unless
    given), and all windows stay within a range, so a hot entity is spread like
    any other; runs that touch the edge of a range are joined to what follows by
    the edge rows alone, at most two an entity and range.

    Defined cases: rows with a null entity are left out. A null label or position
    is an event of its own and ends a run. Null times sort first. Rows that repeat
    entity, time and key are one delivery given twice and count once; equal times
    are ordered by key. Extra columns are ignored, whatever their names; an empty
    table gives no rows.

    Result: the entity, label, first_/last_ key, first_/last_ time, first and last
    position, n_events, duration_us (null where a time is).
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    events = df.filter(F.col(entity).isNotNull()).select(
        F.col(entity).alias("_e"), F.col(time).alias("_t"), F.col(key).alias("_k"), column(label).alias("_v"), column(position).alias("_p")
    )
    parted = events.repartitionByRange(blocks or shuffle_partitions(df.sparkSession), "_e", "_t", "_k").withColumn("_b", F.spark_partition_id())

    # Row number within the entity (and range), repeated deliveries taken out.
    order = W.partitionBy("_e", "_b").orderBy("_t", "_k")
    same = F.coalesce(F.lag("_t").over(order).eqNullSafe(F.col("_t")) & (F.lag("_k").over(order) == F.col("_k")), F.lit(False))
    numbered = (
        parted.withColumn("_again", same)
        .filter(~F.col("_again"))
        .drop("_again")
        .withColumn("_rn", F.row_number().over(order))
        .withColumn("_end", F.lead(F.lit(False), 1, True).over(order))
    )
    # Canonical event: label and island of positions.
    near = W.partitionBy("_e", "_b", "_v").orderBy("_p")
    apart = F.coalesce(F.col("_p") - F.lag("_p").over(near) > tolerance, F.lit(True)).cast("int")
    canonical = numbered.withColumn("_far", apart).withColumn("_c", F.sum("_far").over(near.rowsBetween(W.unboundedPreceding, 0)))
    # The difference of the two row numbers, and the exact check of each step.
    alike = W.partitionBy("_e", "_b", "_v", "_c").orderBy("_rn")
    differed = canonical.withColumn("_d", F.col("_rn") - F.row_number().over(alike))
    close = (F.col("_d") == F.lag("_d").over(alike)) & (F.abs(F.col("_p") - F.lag("_p").over(alike)) <= tolerance) & F.col("_v").isNotNull()
    cut = differed.withColumn("_new", F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1))
    split = cut.withColumn("_s", F.sum("_new").over(alike.rowsBetween(W.unboundedPreceding, 0)))
    runs = (
        split.groupBy("_e", "_b", "_v", "_c", "_s")
        .agg(
            F.count("*").alias("_n"),
            F.min("_rn").alias("_first"),
            F.max("_end").alias("_ends"),
            *[f(c, "_rn").alias(f"{c}{i}") for c in ("_k", "_t", "_p") for i, f in ((0, F.min_by), (1, F.max_by))],
        )
        .withColumn("_edge", (F.col("_first") == 1) | F.col("_ends"))
        .filter(F.col("_edge") | (F.col("_n") >= least))
    )
    # Runs over the edge of ranges: only edge rows meet, other runs stay alone.
    lone = lambda c: F.when(~F.col("_edge"), F.col(c))
    along = W.partitionBy("_e", "_x", "_y").orderBy("_b", "_first")
    goes_on = (
        F.col("_edge")
        & (F.col("_first") == 1)
        & F.lag("_ends").over(along)
        & (F.lag("_v").over(along) == F.col("_v"))
        & (F.abs(F.lag("_p1").over(along) - F.col("_p0")) <= tolerance)
    )
    joined = runs.withColumn("_x", lone("_b")).withColumn("_y", lone("_first")).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    joined = joined.withColumn("_g", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    at = F.col("_b").cast("long") * (1 << 33) + F.col("_first")
    whole = joined.groupBy("_e", "_x", "_y", "_g").agg(
        F.sum("_n").alias("_n"),
        F.min_by("_v", at).alias("_v"),
        *[f(c, at).alias(c) for c, f in (("_k0", F.min_by), ("_k1", F.max_by), ("_t0", F.min_by), ("_t1", F.max_by), ("_p0", F.min_by), ("_p1", F.max_by))],
    )
    name = label if isinstance(label, str) else "label"
    return whole.filter(F.col("_n") >= least).select(
        F.col("_e").alias(entity),
        F.col("_v").alias(name),
        F.col("_k0").alias(f"first_{key}"),
        F.col("_k1").alias(f"last_{key}"),
        F.col("_p0").alias("first_position"),
        F.col("_p1").alias("last_position"),
        F.col("_t0").alias("first_time"),
        F.col("_t1").alias("last_time"),
        F.col("_n").alias("n_events"),
        (F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))).alias("duration_us"),
    )
