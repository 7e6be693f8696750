"""Ranks, tests and false-discovery control.

What orders all rows does so in value blocks: cuts at approximate quantiles (a
bounded number of them is all the driver sees), running figures within a block, and
the sums of the blocks before on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.stats import hypergeometric_tail, normal_two_sided
from strandline.operators.ordering import mid_ranks
from strandline.session import checkpointed, shuffle_partitions

#: Value blocks of an ordering over all rows, for each shuffle partition.
BLOCKS_EACH = 4


def value_blocks(df: DataFrame, column: str, blocks: int | None = None) -> DataFrame:
    """Rows with ``_block``: equal values in one block, blocks in the order of values."""
    blocks = blocks or max(8, BLOCKS_EACH * shuffle_partitions(df.sparkSession))
    cuts = df.select(F.percentile_approx(column, [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    return df.withColumn("_block", F.size(F.filter(edges, lambda c: c < F.col(column))))


def _on(columns: list[str]) -> list[str]:
    return [*columns, "_block"]


def adjust_p_values(df: DataFrame, *, p: str, family: list[str], out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg within each family; null p-values stay null and do not count.

    Done on distinct p-values: running counts and the least p m / rank from the
    largest on, both in value blocks, so one family may be of any size.
    """
    known = df.filter(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    placed = value_blocks(checkpointed(known), "_p")
    key = _on(family)
    totals = placed.groupBy(*key).agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*family).orderBy("_block") if family else W.partitionBy(F.lit(0)).orderBy("_block")
    everything = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    offsets = totals.select(*key, F.coalesce(F.sum("_sum").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(everything).alias("_m"))
    match = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key]
    inside = W.partitionBy(*key)
    scored = placed.alias("a").join(offsets.alias("b"), match("a", "b")).select("a.*", "_before", "_m")
    scored = scored.withColumn("_q", F.col("_p") * F.col("_m") / (F.col("_before") + F.sum("_n").over(inside.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))))
    least = scored.groupBy(*key).agg(F.min("_q").alias("_least"))
    after = least.select(*key, F.min("_least").over((W.partitionBy(*family) if family else W.partitionBy(F.lit(0))).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    final = scored.alias("a").join(after.alias("b"), match("a", "b")).select("a.*", "_after")
    down = inside.orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0)
    final = final.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(family)], F.col("_p").alias("_pk"), F.least(F.min("_q").over(down), "_after", F.lit(1.0)).alias(out))
    on = (F.col(p) == F.col("_pk")) if not family else (F.col(p) == F.col("_pk"))
    for i, c in enumerate(family):
        on = on & F.col(c).eqNullSafe(F.col(f"_f{i}"))
    return df.join(final, on, "left").drop("_pk", *[f"_f{i}" for i in range(len(family))])


def target_decoy(df: DataFrame, *, score: str, decoy: Column, key: str) -> DataFrame:
    """q-values by target-decoy competition over all rows, best score first.

    At each row (decoys + 1) / max(targets, 1) of the rows so far, at most 1, and of
    these the least from the worst row on. Ties go by ``key``.
    """
    rows = value_blocks(df.filter(F.col(score).isNotNull()).withColumn("_d", decoy.cast("int")), score)
    sums = rows.groupBy("_block").agg(F.sum("_d").alias("_ds"), F.count("*").alias("_ns"))
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_block", F.coalesce(F.sum("_ds").over(above), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_ns").over(above), F.lit(0)).alias("_n0"))
    inside = W.partitionBy("_block").orderBy(F.desc(score), key).rowsBetween(W.unboundedPreceding, 0)
    counted = rows.join(offsets, "_block").withColumn("_dc", F.col("_d0") + F.sum("_d").over(inside)).withColumn("_nc", F.col("_n0") + F.count("*").over(inside))
    rate = F.least(F.lit(1.0), (F.col("_dc") + 1) / F.greatest(F.col("_nc") - F.col("_dc"), F.lit(1)))
    rated = counted.withColumn("_fdr", rate)
    least = rated.groupBy("_block").agg(F.min("_fdr").alias("_least"))
    below = least.select("_block", F.min("_least").over(W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_rest"))
    up = W.partitionBy("_block").orderBy(F.asc(score), F.desc(key)).rowsBetween(W.unboundedPreceding, 0)
    return rated.join(below, "_block").withColumn("q_value", F.least(F.min("_fdr").over(up), "_rest")).drop("_d", "_d0", "_n0", "_dc", "_nc", "_fdr", "_rest", "_block")


def welch(df: DataFrame, *, by: list[str], second: Column, value: Column) -> DataFrame:
    """Welch's t and degrees of freedom of two groups; null below two values a group or
    without variance. Also the difference of means, second less first."""
    rows = df.withColumn("_v", value).withColumn("_g", second)
    side = lambda f, b: f(F.when(F.col("_g") == F.lit(b), F.col("_v")))
    stats = rows.groupBy(*by).agg(*[side(f, b).alias(f"{n}{int(b)}") for n, f in (("_n", F.count), ("_m", F.avg), ("_s", F.var_samp)) for b in (False, True)])
    a, b = F.col("_s0") / F.col("_n0"), F.col("_s1") / F.col("_n1")
    able = (F.col("_n0") >= 2) & (F.col("_n1") >= 2) & (a + b >= 1e-30)
    freedom = F.pow(a + b, F.lit(2)) / (a * a / (F.col("_n0") - 1) + b * b / (F.col("_n1") - 1))
    return stats.select(
        *by,
        F.col("_n0").alias("n_first"),
        F.col("_n1").alias("n_second"),
        (F.col("_m1") - F.col("_m0")).alias("difference"),
        F.when(able, (F.col("_m1") - F.col("_m0")) / F.sqrt(a + b)).alias("t"),
        F.when(able, freedom).alias("df"),
    )


def spearman(df: DataFrame, *, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns per group; 0 where one does not vary."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranked = mid_ranks(mid_ranks(rows.select(*by, x, y), by, x, "_x"), by, y, "_y")
    rho = F.corr("_x", "_y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.isnan(rho), 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("rho"))


def rank_sum(df: DataFrame, *, by: list[str], group: Column, value: str) -> DataFrame:
    """Wilcoxon rank sum of the rows where ``group`` holds against the others: U, the area
    under the curve, z (no correction for ties) and its p-value (1 for 20 rows or fewer)."""
    ranked = mid_ranks(df.filter(F.col(value).isNotNull()).withColumn("_g", group.cast("int")).select(*by, value, "_g"), by, value, "_r")
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_g").alias("n_in"), F.sum(F.when(F.col("_g") == 1, F.col("_r"))).alias("_w"))
    ok = sums.filter((F.col("n_in") > 0) & (F.col("n_in") < F.col("n")))
    n1, n2 = F.col("n_in"), F.col("n") - F.col("n_in")
    u = F.col("_w") - n1 * (n1 + 1) / 2
    scored = ok.withColumn("u", u).withColumn("auc", u / (n1 * n2)).withColumn("z", (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (F.col("n") + 1) / 12.0))
    return scored.withColumn("p", F.when(F.col("n") <= 20, 1.0).otherwise(normal_two_sided(F.col("z")))).drop("_w")


def size_factors(df: DataFrame, *, gene: list[str], sample: list[str], value: str) -> DataFrame:
    """Median-of-ratios factors: each sample's values over the genes' geometric means of positive ones."""
    positive = df.filter(F.col(value) > 0)
    means = positive.groupBy(*gene).agg(F.avg(F.log(value)).alias("_ref"))
    ratios = positive.join(means, gene).withColumn("_ratio", F.exp(F.log(value) - F.col("_ref")))
    return ratios.groupBy(*sample).agg(F.expr("percentile(_ratio, 0.5)").alias("size_factor"))


def over_representation(query: DataFrame, sets: DataFrame, *, set_key: str, gene: str = "gene") -> DataFrame:
    """Hypergeometric enrichment of the query genes in each set, with adjusted p-values.

    The universe is all genes of all sets; the query counts whole, genes outside of
    the universe too. Sets without a query gene are left out.
    """
    members = sets.select(set_key, gene).distinct()
    asked = query.select(gene).distinct()
    size = members.groupBy(set_key).agg(F.count("*").alias("set_size"))
    hits = members.join(asked, gene).groupBy(set_key).agg(F.count("*").alias("overlap"))
    constants = members.agg(F.count_distinct(gene).alias("_total")).crossJoin(asked.agg(F.count("*").alias("_drawn")))
    rows = hits.join(size, set_key).crossJoin(constants)
    scored = checkpointed(rows.withColumn("p", hypergeometric_tail(F.col("overlap"), F.col("set_size"), F.col("_drawn"), F.col("_total"))).drop("_total", "_drawn"))
    return adjust_p_values(scored, p="p", family=[])


def ranked_all(df: DataFrame, *, score: str, key: str) -> DataFrame:
    """All rows with their ``rank`` from 1, highest score first, ties by ``key``: counted
    inside equal ranges of the order, after the sizes of the ranges before."""
    ordered = df.repartitionByRange(shuffle_partitions(df.sparkSession), F.desc(score), F.col(key))
    placed = checkpointed(ordered.withColumn("_block", F.spark_partition_id()))
    before = W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_block").agg(F.count("*").alias("_size")).select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_block").orderBy(F.desc(score), key)
    return placed.join(offsets, "_block").withColumn("rank", F.col("_before") + F.row_number().over(inside)).drop("_block", "_before")


def enrichment_scores(ranked: DataFrame, sets: DataFrame, *, set_key: str, gene: str = "gene", rank: str = "rank", even: bool = False) -> DataFrame:
    """Running-sum enrichment score of each set along a ranking (ranks from 1).

    A hit adds sqrt(misses / hits), a miss takes sqrt(hits / misses), or with ``even``
    one over the hits and one over the misses; the score is
    the furthest from zero, which a sum reaches at a hit or right before one, so
    only hits are visited. With it, the number of leading genes up to (or from) it.
    """
    points = _points(ranked, sets, set_key, gene, rank, even)
    return (
        _peaks(points, set_key)
        .select(
            set_key,
            "n_hits",
            F.when(F.col("_rises"), F.col("_top._at")).otherwise(F.col("_low._ahead")).alias("es"),
            F.when(F.col("_rises"), -F.col("_top.col2")).otherwise(F.col("n_hits") - F.col("_low._i") + 1).alias("n_leading"),
        )
    )


def leading_genes(ranked: DataFrame, sets: DataFrame, *, set_key: str, gene: str = "gene", rank: str = "rank") -> DataFrame:
    """The genes of each set up to its peak, or from it on where the score is negative: set_key, gene, rank."""
    points = _points(ranked, sets, set_key, gene, rank)
    peaks = _peaks(points, set_key).select(set_key, "_rises", (-F.col("_top.col2")).alias("_to"), F.col("_low._i").alias("_from"))
    inside = F.when(F.col("_rises"), F.col("_i") <= F.col("_to")).otherwise(F.col("_i") >= F.col("_from"))
    return points.join(peaks, set_key).filter(inside).select(set_key, gene, rank)


def _points(ranked: DataFrame, sets: DataFrame, set_key: str, gene: str, rank: str, even: bool = False) -> DataFrame:
    """Hits of each set in order, with the running sum at (``_at``) and right before (``_ahead``) each."""
    members = sets.select(set_key, gene).distinct().join(ranked.select(gene, rank), gene)
    total = ranked.agg(F.count("*").alias("_all"))
    along = W.partitionBy(set_key).orderBy(rank)
    hits = members.withColumn("_i", F.row_number().over(along)).withColumn("_n", F.count("*").over(W.partitionBy(set_key))).crossJoin(total)
    hits = hits.filter(F.col("_n") < F.col("_all"))
    up, down = F.sqrt((F.col("_all") - F.col("_n")) / F.col("_n")), F.sqrt(F.col("_n") / (F.col("_all") - F.col("_n")))
    if even:
        up, down = 1.0 / F.col("_n"), 1.0 / (F.col("_all") - F.col("_n"))
    at = F.col("_i") * up - (F.col(rank) - F.col("_i")) * down
    return hits.withColumn("_at", at).withColumn("_ahead", at - up)


def _peaks(points: DataFrame, set_key: str) -> DataFrame:
    """Where each running sum is furthest from zero: at its top hit, or right before its lowest."""
    ends = points.groupBy(set_key).agg(F.max("_n").alias("n_hits"), F.max(F.struct("_at", -F.col("_i"))).alias("_top"), F.min(F.struct("_ahead", F.col("_i"))).alias("_low"))
    return ends.withColumn("_rises", F.abs(F.col("_top._at")) >= F.abs(F.col("_low._ahead")))
