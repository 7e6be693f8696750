"""Classes and summaries of copy-number segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of copy number, exclusive, and the class above the last (fixed values).
COPY_CLASSES = (("homdel", 0.5), ("hetdel", 1.5), ("diploid", 2.5), ("lowamp", 4.5))
TOP_CLASS = "highamp"


def copy_class(copies: Column) -> Column:
    """Class of an absolute copy number; null for null and NaN."""
    out = None
    for name, below in COPY_CLASSES:
        out = (F if out is None else out).when(copies < below, name)
    return F.when(~F.isnan(copies.cast("double")), out.when(copies.isNotNull(), TOP_CLASS))


def ratio_class(ratio: Column) -> Column:
    """Class of a log2 ratio (thresholds 0.3 and 0.7; never a homozygous deletion)."""
    known = ratio.isNotNull() & ~F.isnan(ratio)
    level = F.when(ratio > F.lit(0.7).cast("float"), "highamp").when(ratio > F.lit(0.3).cast("float"), "lowamp").when(ratio < F.lit(-0.3).cast("float"), "hetdel").otherwise("diploid")
    return F.when(known, level)


def summarize_segments(df: DataFrame, by: list[str]) -> DataFrame:
    """Segments per class, bases, altered part of them, length-weighted ploidy (2 if unknown)."""
    width = F.col("end_pos") - F.col("start_pos")
    rows = df.withColumn("_w", width).withColumn("_kind", copy_class(F.col("copy_number")))
    names = [name for name, _ in COPY_CLASSES] + [TOP_CLASS]
    copies = F.col("copy_number").cast("double")
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("n_segments"),
        *[F.count(F.when(F.col("_kind") == k, 1)).alias(f"n_{k}") for k in names],
        F.sum("_w").alias("n_bases"),
        F.sum(F.when(F.col("_kind") != "diploid", F.col("_w")).otherwise(0)).alias("_altered"),
        F.sum(copies * F.col("_w")).alias("_weighted"),
        F.sum(F.when(copies.isNotNull(), F.col("_w"))).alias("_known"),
    )
    return (
        counted.withColumn("altered", F.round(F.col("_altered") / F.col("n_bases"), 6))
        .withColumn("ploidy", F.round(F.coalesce(F.try_divide("_weighted", "_known"), F.lit(2.0)), 5))
        .drop("_altered", "_weighted", "_known")
    )


def driver_segments(df: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` highest amplifications and deepest homozygous deletions that name a gene."""
    rows = df.filter(F.col("gene") != "").withColumn("kind", copy_class(F.col("copy_number")))
    pick = lambda kind, order: rows.filter(F.col("kind") == kind).orderBy(order, "segment_id").limit(limit)
    both = pick("highamp", F.desc("copy_number")).unionByName(pick("homdel", F.asc("copy_number")))
    return both.select("segment_id", "gene", "kind", F.round(F.col("copy_number").cast("double"), 4).alias("copy_number"))
