"""Scores of samples against catalogues that the caller brings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def risk_scores(calls: DataFrame, catalogue: DataFrame, baselines: DataFrame, *, sample: str) -> DataFrame:
    """Polygenic scores per sample and disease.

    ``catalogue``: disease, chrom, pos, risk_allele, odds_ratio; a call matches at its
    position with the risk allele among its alleles, whatever the case. The score is
    the sum of ln(odds ratio), ``z`` its distance from the disease's baseline
    (``baselines``: disease, mean, spread); each catalogue row counts once a sample.
    """
    entries = catalogue.select("disease", "chrom", "pos", F.upper("risk_allele").alias("_risk"), F.log("odds_ratio").alias("_weight"))
    seen = calls.select(sample, "chrom", "pos", F.upper("alt_allele").alias("_alt")).filter(F.col(sample).isNotNull())
    hits = seen.join(entries, ["chrom", "pos"]).filter(F.array_contains(F.split("_alt", ","), F.col("_risk")))
    once = hits.select(sample, "disease", "chrom", "pos", "_risk", "_weight").distinct()
    summed = once.groupBy(sample, "disease").agg(F.sum("_weight").alias("score"), F.count("*").alias("n_matched"))
    placed = summed.join(baselines, "disease")
    return placed.select(sample, "disease", "score", "n_matched", F.try_divide(F.col("score") - F.col("mean"), F.col("spread")).alias("z"))


def near_sites(sites: DataFrame, catalogue: DataFrame, *, key: str, reach: int = 1) -> DataFrame:
    """For each catalogue row (``key``, chrom, pos) the first site at most ``reach`` away.

    ``sites``: chrom, pos, value. Of several, the one with the lowest position, then
    the lowest value.
    """
    around = catalogue.select(key, "chrom", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.col("pos") + d)).alias("pos"))
    return around.join(sites.select("chrom", "pos", "value"), ["chrom", "pos"]).groupBy(key).agg(F.min(F.struct("pos", "value")).alias("_x")).select(key, "_x.pos", "_x.value")


def clock_age(sites: DataFrame, catalogue: DataFrame, *, key: str, intercept: float, least: int = 10) -> DataFrame:
    """Age from methylation: the weighted sum of the matched catalogue rows (``weight``)
    over values in per cent, plus the intercept, taken back from its log scale below
    adulthood; 0 to 120, null with fewer than ``least`` matches."""
    found = near_sites(sites, catalogue, key=key).join(catalogue.select(key, "weight"), key)
    total = found.agg(F.count("*").alias("n_matched"), (F.coalesce(F.sum(F.col("weight") * F.col("value") / 100), F.lit(0.0)) + intercept).alias("_x"))
    years = F.when(F.col("_x") < 0, 21 * F.exp("_x") - 1).otherwise(21 * F.col("_x") + 20)
    return total.select("n_matched", F.when(F.col("n_matched") >= least, F.greatest(F.lit(0.0), F.least(F.lit(120.0), years))).alias("age"))


def panel_score(expression: DataFrame, panel: DataFrame, *, top: float = 100.0) -> DataFrame:
    """Weighted mean of log2(value + 1) / log2(top + 1) over a gene panel.

    ``panel``: gene, weight, aliases; a gene not found by its name is looked up by its
    aliases in turn. ``expression``: gene, value.
    """
    names = panel.select("gene", "weight", F.posexplode(F.concat(F.array("gene"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_order", "_name"))
    values = expression.groupBy(F.col("gene").alias("_name")).agg(F.avg("value").alias("value"))
    found = names.join(values, "_name").groupBy("gene").agg(F.min_by("value", "_order").alias("value"), F.first("weight").alias("weight"))
    level = F.log2(F.col("value") + 1) / F.log2(F.lit(top) + 1)
    return found.agg(F.count("*").alias("n_found"), F.try_divide(F.sum(level * F.col("weight")), F.sum("weight")).alias("score"))
