"""Small reports of scores, features, sites and cohorts; all are grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.variants import variant_class


def score_histogram(df: DataFrame, *, score: str, bins: int = 20) -> DataFrame:
    """Rows, median and highest of a score, and rows per bin: bins are a ``bins``-th of the highest wide, one at least."""
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    ends = known.agg(F.max(score).alias("_top"), F.expr(f"percentile({score}, 0.5)").alias("median"), F.count("*").alias("n_rows"))
    width = F.greatest(F.col("_top") / bins, F.lit(1.0))
    placed = known.crossJoin(ends).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.greatest(F.col(score), F.lit(0.0)) / width)))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.first("median").alias("median"), F.first("n_rows").alias("n_rows"))


def chromosome_copies(df: DataFrame, by: list[str], *, ratio: str, depth: str, altered: float = 0.3) -> DataFrame:
    """Segments of each group: how many, mean ratio, median depth, part of them beyond ``altered``."""
    known = df.filter(F.col(ratio).isNotNull() & ~F.isnan(ratio)).withColumn("_r", F.col(ratio).cast("double"))
    return known.groupBy(*by).agg(
        F.count("*").alias("n_segments"), F.avg("_r").alias("mean_ratio"), F.expr(f"percentile(cast({depth} as double), 0.5)").alias("median_depth"), F.avg((F.abs("_r") > altered).cast("double")).alias("altered")
    )


def site_report(sites: DataFrame, alleles: DataFrame, *, on: list[str]) -> DataFrame:
    """Tumour sites by verdict: how many, mean frequency, and of those that pass their
    transitions over transversions (0 without any).

    ``sites``: the result of ``contrast_sites``; ``alleles``: site, ref_allele,
    alt_allele, each pair counted once.
    """
    kinds = alleles.select(*on, variant_class(F.col("ref_allele"), F.col("alt_allele")).alias("_k"), "ref_allele", "alt_allele").distinct()
    of_site = kinds.groupBy(*on).agg(F.count(F.when(F.col("_k") == "Transition", 1)).alias("_ts"), F.count(F.when(F.col("_k") == "Transversion", 1)).alias("_tv"))
    joined = sites.join(of_site, on, "left")
    sums = joined.groupBy("verdict").agg(F.count("*").alias("n_sites"), F.avg(F.col("t_alt") / F.col("t_depth")).alias("frequency"), F.coalesce(F.sum("_ts"), F.lit(0)).alias("n_ts"), F.coalesce(F.sum("_tv"), F.lit(0)).alias("n_tv"))
    return sums.withColumn("titv", F.coalesce(F.try_divide("n_ts", "n_tv"), F.lit(0.0)))


def assignment_report(counts: DataFrame, total: DataFrame, *, gene: str, n: str) -> DataFrame:
    """One row: rows assigned to genes, their part of all (``total``: one number), genes seen."""
    seen = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("assigned"), F.count(F.when(F.col(n) > 0, F.col(gene))).alias("detected"))
    return seen.crossJoin(total.toDF("_all")).select("assigned", "detected", F.coalesce(F.try_divide("assigned", "_all"), F.lit(0.0)).alias("rate"))


def significant(df: DataFrame, *, p: str, effect: str, most: float = 0.05, least: float = 1.0) -> Column:
    """Whether a test passes: adjusted p below ``most`` and the effect at least ``least``;
    without a p-value the effect alone decides."""
    strong = F.abs(F.col(effect)) >= least
    return F.when(F.col(p).isNull() | F.isnan(p), strong).otherwise((F.col(p) < most) & strong)


def correlation_matrix(long: DataFrame, *, row: list[str], name: str, value: str) -> DataFrame:
    """Pearson's r of every pair of named values over the rows that have both: a, b, n, ``r``."""
    known = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*row, F.col(name).alias("_name"), F.col(value).cast("double").alias("_v"))
    a = known.withColumnsRenamed({"_name": "a", "_v": "_x"})
    b = known.withColumnsRenamed({"_name": "b", "_v": "_y"})
    r = F.corr("_x", "_y")
    return a.join(b, row).filter(F.col("a") <= F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.isnan(r), 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("r"))


def log_sum_exp(*terms: Column) -> Column:
    """ln of the sum of exponentials, without overflow; null terms count for nothing."""
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = F.lit(0.0)
    for term in terms:
        total = total + F.coalesce(F.exp(term - top), F.lit(0.0))
    return top + F.log(total)


def log_one_less_exp(x: Column) -> Column:
    """ln(1 - exp(x)) of a negative x, exact near zero and far from it."""
    return F.when(x >= 0, None).when(x > -0.6931471805599453, F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))
