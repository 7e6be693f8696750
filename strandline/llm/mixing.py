"""Mixing documents of several sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.session import shuffle_partitions

#: Buckets per shuffle partition into which each source's shuffled order, and the
#: order of the whole mix, are cut.
FINENESS = 4


def source_plan(sizes: DataFrame, targets: DataFrame, *, budget: float | None = None) -> DataFrame:
    """One row per target source: its share, its copies at most, what it has, the budget.

    ``sizes``: source, size. ``targets``: source, target_share, max_repeats. Shares
    count among the sources that have documents: what others should have given is
    divided in proportion. The budget, unless given, is the largest total that all
    these sources can share without one running dry.
    """
    goals = (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.sum("size").alias("_have"), F.count("*").alias("n_documents"))
    joined = goals.join(have, "source", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
    able = F.when((F.col("_have") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    shared = joined.withColumn("_able", able).withColumn("_share", F.expr("try_divide(_able, sum(_able) OVER (PARTITION BY 0))"))
    most = F.min(F.when(F.col("_share") > 0, F.col("_have") * F.col("max_repeats") / F.col("_share"))).over(W.partitionBy(F.lit(0)))
    planned = shared.withColumn("_budget", most if budget is None else F.lit(float(budget)))
    return planned.withColumn("_copies", F.least(F.col("max_repeats"), F.ceil(F.expr("try_divide(_budget, _have)"))).cast("int"))


def mix_sources(sizes: DataFrame, targets: DataFrame, *, key: str, budget: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix, one row per included copy of a document, and the plan it follows.

    ``sizes`` has ``key``, ``source``, ``size`` (tokens, say); ``targets`` has
    ``source``, ``target_share``, ``max_repeats``. Weighted fair queueing: each
    copy of a document has a virtual finish time, the cumulative size of its
    source in shuffled order divided by the source's share (a second copy comes
    after all first ones, in another order); the mix is all copies in the order of
    finish, source, copy and key, as long as their total stays within the budget.
    A source that runs dry leaves its part to the others.

    The shuffled order is a hash of key, copy and ``seed``, so it is the same at
    every run. Cumulative sizes are taken within even buckets of that hash, on top
    of the sums of the buckets before; so is the total of the mix, in even buckets
    of finish times. A source with a third of all documents is spread like any
    other, and each bucket table has a bounded number of rows.

    Defined cases: documents without size or key, of a null source or of one
    without target are left out, as are sources with a share or repeats of zero;
    target rows of one source are added up; rows that repeat a key count each. An
    empty table or target gives an empty mix.

    Mix: key, source, copy_no (from 1), size, finish.
    """
    buckets = FINENESS * shuffle_partitions(sizes.sparkSession)
    docs = sizes.select(F.col(key).alias("_key"), F.col("source").alias("_source"), F.col("size").alias("_size")).filter(
        (F.col("_size") > 0) & F.col("_key").isNotNull() & F.col("_source").isNotNull()
    )
    plan = source_plan(docs.select(F.col("_source").alias("source"), F.col("_size").alias("size")), targets, budget=budget)
    used = plan.filter((F.col("_share") > 0) & (F.col("_copies") > 0)).select(F.col("source").alias("_source"), "_share", "_copies", "_budget")
    # Each source's plan meets its documents once a bucket, so no task gets all of one.
    spread = used.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_salt"))
    copies = (
        docs.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
        .join(spread, ["_source", "_salt"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_copy", "_key"), 1))
        .withColumn("_bucket", F.floor(F.col("_u") / (2.0**63 / buckets)).cast("int"))
        .select("_key", "_source", "_size", "_share", "_budget", "_copy", "_u", "_bucket")
    )
    place = ["_source", "_copy", "_bucket"]
    sums = copies.groupBy(*place).agg(F.sum("_size").alias("_sum"))
    earlier = W.partitionBy("_source").orderBy("_copy", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*place, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy(*place).orderBy("_u", "_key").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        copies.join(before, place)
        .withColumn("_of_source", F.col("_before") + F.sum("_size").over(within))
        .filter(F.col("_of_source") <= F.col("_budget"))
        .withColumn("_finish", F.col("_of_source") / F.col("_share"))
        # Time runs as fast as the total, or slower once a source is dry.
        .withColumn("_slot", F.floor(F.col("_finish") * buckets / F.col("_budget")))
    )
    slots = queued.groupBy("_slot").agg(F.sum("_size").alias("_sum"))
    ahead = slots.select("_slot", F.coalesce(F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    order = W.partitionBy("_slot").orderBy("_finish", "_source", "_copy", "_key").rowsBetween(W.unboundedPreceding, 0)
    mix = (
        queued.join(ahead, "_slot")
        .filter(F.col("_ahead") <= F.col("_budget"))
        .withColumn("_cum", F.col("_ahead") + F.sum("_size").over(order))
        .filter(F.col("_cum") <= F.col("_budget"))
        .select(
            F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_copy").alias("copy_no"), F.col("_size").alias("size"), F.col("_finish").alias("finish")
        )
    )
    return mix, plan


def reached_shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: the share asked for and the one reached, sizes, copies."""
    got = mix.groupBy("source").agg(F.sum("size").alias("_got"), F.count("*").alias("n_rows"), F.max("copy_no").alias("repeats"))
    total = F.sum(F.coalesce("_got", F.lit(0))).over(W.partitionBy(F.lit(0)))
    return plan.join(got, "source", "left").select(
        "source",
        "target_share",
        F.round(F.coalesce(F.try_divide(F.coalesce("_got", F.lit(0)), total), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("_got", F.lit(0)).alias("size"),
        "n_documents",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        "max_repeats",
    )
