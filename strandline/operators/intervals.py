"""Intervals per entity: continuous periods, gaps and overlaps.

All intervals are half-open. Work is split by position blocks of fixed width, so
no task ever needs all intervals of one entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions per block. A block holds at most this many distinct starts.
BLOCK_WIDTH = 1 << 20


def periods_and_gaps(
    df: DataFrame,
    *,
    entity: list[str],
    start: str = "start_pos",
    end: str = "end_pos",
    block_width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Continuous periods and the gaps between them, per entity.

    Starts and ends are sorted independently: after the i-th pair of ranks there
    is a gap exactly where the next start exceeds the i-th end. Boundaries so
    found pair up to periods. Rows whose start or end is null, or whose start is
    not before the end, are left out; touching intervals are continuous; nested
    and repeated rows change nothing; an empty table gives no rows; nulls in the
    entity columns form an entity of their own.

    Before any ranking, rows are reduced to the longest interval of each start,
    partly on the map side, so that a block of ``block_width`` positions holds no
    more rows than positions, however hot its entity is. What reaches over from
    earlier blocks is the running maximum of one row per block.

    Result: the entity columns, ``kind`` (``period`` or ``gap``), ``start_pos``,
    ``end_pos``.
    """
    keys = [f"_e{i}" for i in range(len(entity))]
    rows = (
        df.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).alias("_s"), F.col(end).alias("_f"))
        .filter(F.col("_s") < F.col("_f"))
        .withColumn("_b", F.floor(F.col("_s") / block_width))
    )
    longest = rows.groupBy(*keys, "_b", "_s").agg(F.max("_f").alias("_f"))
    block = [*keys, "_b"]

    # One row a block: how far earlier blocks reach into it, and the entity's last end.
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reach = (
        rows.groupBy(*block)
        .agg(F.max("_f").alias("_m"))
        .select(
            *[F.col(c).alias(f"{c}r") for c in block],
            F.max("_m").over(earlier).alias("_carry"),
            F.max("_m").over(W.partitionBy(*keys)).alias("_last"),
        )
    )

    # Independent ranks of starts and ends inside a block, paired by rank.
    points = longest.select(*block, F.posexplode(F.array("_s", "_f")).alias("_kind", "_at")).repartition(*block)
    ranked = points.select("*", F.row_number().over(W.partitionBy(*block, "_kind").orderBy("_at")).alias("_r"))
    paired = ranked.groupBy(*block, "_r").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_at"))).alias("_s"),
        F.max(F.when(F.col("_kind") == 1, F.col("_at"))).alias("_f"),
    )
    order = W.partitionBy(*block).orderBy("_r")
    # A boundary: a period begins at _s; _until is where the period before it ended.
    starts = (
        paired.withColumn("_before", F.lag("_f").over(order))
        .join(reach, [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in block])
        .withColumn("_until", F.greatest("_before", "_carry"))
        .filter(F.col("_until").isNull() | (F.col("_s") > F.col("_until")))
    )
    # A period ends where the next boundary says so. Only the outermost boundaries of
    # each block meet those of other blocks, the rest stay among themselves.
    along = W.partitionBy(*block).orderBy("_s")
    edged = starts.withColumn("_prev", F.lag("_s").over(along)).withColumn("_next", F.lead("_until").over(along))
    edge = F.col("_prev").isNull() | F.col("_next").isNull()
    across = W.partitionBy(*keys, "_x", "_y").orderBy("_s")
    whole = (
        edged.withColumn("_x", F.when(~edge, F.col("_b")))
        .withColumn("_y", F.when(~edge, F.col("_s")))
        .withColumn("_next", F.coalesce("_next", F.lead("_until").over(across), "_last"))
    )
    out = whole.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("_s").alias("start_pos"), F.col("_next").alias("end_pos")),
                F.struct(F.lit("gap").alias("kind"), F.col("_until").alias("start_pos"), F.col("_s").alias("end_pos")),
            )
        ).alias("_x"),
    ).select(*[F.col(k).alias(c) for c, k in zip(entity, keys)], "_x.*")
    return out.filter(F.col("start_pos").isNotNull())
