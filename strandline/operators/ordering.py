"""Orders within entities of any size: numbers, blocks and running figures.

Rows are range-sorted by entity and order, so an entity with a third of all rows is
spread like any other; figures run inside a block and one small row a block and
entity carries what came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.session import checkpointed

#: Rows of a block of an entity's order.
BLOCK_ROWS = 100_000


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls match."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(renamed, match).drop(*[f"_on_{c}" for c in on])


def numbered(df: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_i``, their number from 0 within their entity in the order (which must tell rows apart)."""
    ranged = df.repartitionByRange(*entity, *order)
    placed = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*entity, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*entity).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*entity, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part", *entity).orderBy(*order)
    counted = placed.withColumn("_r", F.row_number().over(inside) - 1)
    return _joined(counted, offsets, [*entity, "_part"]).withColumn("_i", F.col("_before") + F.col("_r")).drop("_before", "_r", "_part")


def in_blocks(rows: DataFrame, *, before: int = 0, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Numbered rows with their block ``_b``, and again (``_own`` false) as margin of the
    blocks that have one of the next ``before`` or the last ``after`` rows."""
    own = F.floor(F.col("_i") / size)
    places = F.array(own, F.when(F.col("_i") - own * size < after, own - 1), F.when((own + 1) * size - 1 - F.col("_i") < before, own + 1))
    spread = rows.withColumn("_b", F.explode(F.array_distinct(F.filter(places, lambda b: b.isNotNull() & (b >= 0)))))
    return spread.withColumn("_own", F.col("_b") == F.floor(F.col("_i") / size))


def running(rows: DataFrame, entity: list[str], value: Column, out: str, how: Callable = F.sum, *, inclusive: bool = True) -> DataFrame:
    """Adds ``out``: the sum or maximum (``how``) of ``value`` over the rows so far in each
    entity's numbered order, with or without the row itself; null where there is none."""
    blocked = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col("_i") / BLOCK_ROWS))
    totals = blocked.groupBy(*entity, "_b").agg(how("_v").alias("_t"))
    earlier = W.partitionBy(*entity).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*entity, "_b", how("_t").over(earlier).alias("_carried"))
    inside = W.partitionBy(*entity, "_b").orderBy("_i").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    both = _joined(blocked.withColumn("_in", how("_v").over(inside)), carried, [*entity, "_b"])
    if how is F.sum:
        total = F.when(F.col("_in").isNotNull() | F.col("_carried").isNotNull(), F.coalesce("_in", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    else:
        total = F.greatest("_in", "_carried")
    return both.withColumn(out, total).drop("_v", "_b", "_in", "_carried")


def mid_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rows with their average rank within the group, equal values sharing theirs.

    Ranks are worked out on distinct values with their counts; rows get theirs back
    by a join on group and value.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    summed = running(numbered(counted, by, [value]), by, F.col("_n"), "_upto")
    ranks = summed.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return _joined(df, ranks, [*by, value])
