"""Grouped summaries and scores of variant calls.

Every function takes a DataFrame of calls (ref_allele, alt_allele, qual, af, ...)
and grouping columns; all are partial and final aggregates, so they merge on the
map side and no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the allele-frequency histogram over [0, 1).
AF_BINS = 20
#: Complements of bases (fixed values).
_BASES, _COMPLEMENTS = "ACGT", "TGCA"


def variant_class(ref: Column, alt: Column) -> Column:
    """``Transition``, ``Transversion``, ``Indel`` or ``Other``.

    Compared without regard to case. A single base with a longer alternative counts
    by its first alternative; other differing lengths are indels.
    """
    r, a = F.upper(ref), F.upper(alt)
    first = F.substring_index(a, ",", 1)
    b = F.when((F.length(r) == 1) & (F.length(a) > 1), first).otherwise(a)
    pair = F.concat(r, b)
    return (
        F.when(F.length(r) != F.length(b), "Indel")
        .when(F.length(r) != 1, "Other")
        .when(pair.isin("AG", "GA", "CT", "TC"), "Transition")
        .when(r.isin(*_BASES) & b.isin(*_BASES), "Transversion")
        .when(pair.isNotNull(), "Other")
    )


def af_bin(af: Column, bins: int = AF_BINS) -> Column:
    """Histogram bin of an allele frequency; below the range the first, above the last."""
    wide = af.cast("double")
    return F.when(wide.isNotNull() & ~F.isnan(wide), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(wide * bins)))).cast("int")


def summarize_variants(df: DataFrame, by: list[str], *, high_quality: float = 30.0) -> DataFrame:
    """Counts of calls, SNPs, indels, transitions and transversions, their ratio
    (0 without transversions), calls above ``high_quality``, distinct genes and positions."""
    kind = variant_class(F.col("ref_allele"), F.col("alt_allele"))
    counted = (
        df.withColumn("_kind", kind)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_calls"),
            F.count(F.when(F.col("_kind").isin("Transition", "Transversion"), 1)).alias("n_snp"),
            F.count(F.when(F.col("_kind") == "Indel", 1)).alias("n_indel"),
            F.count(F.when(F.col("_kind") == "Transition", 1)).alias("n_ts"),
            F.count(F.when(F.col("_kind") == "Transversion", 1)).alias("n_tv"),
            F.count(F.when(F.col("qual") > high_quality, 1)).alias("n_high"),
        )
        .withColumn("titv", F.round(F.when(F.col("n_tv") > 0, F.col("n_ts") / F.col("n_tv")).otherwise(0.0), 6))
    )
    return counted


def distinct_sites(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (chrom, pos) and genes per group; two narrow distinct aggregates."""
    return df.groupBy(*by).agg(F.count_distinct("chrom", "pos").alias("n_sites"), F.count_distinct(F.when(F.col("gene") != "", F.col("gene"))).alias("n_genes"))


def approx_sites(df: DataFrame, by: list[str], rsd: float = 0.008) -> DataFrame:
    """Distinct positions by a mergeable sketch with the given relative error."""
    return df.groupBy(*by).agg(F.approx_count_distinct(F.xxhash64("chrom", "pos"), rsd).alias("n_sites"))


def af_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    """Calls per allele-frequency bin."""
    return df.withColumn("bin", af_bin(F.col("af"))).filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n_calls"))


def indel_changes(ref: Column, alt: Column) -> tuple[Column, Column]:
    """Length change of an indel (negative for deletions) and its changed suffix."""
    change = F.length(alt) - F.length(ref)
    longer, shorter = F.when(change > 0, alt).otherwise(ref), F.when(change > 0, ref).otherwise(alt)
    return change, longer.substr(F.length(shorter) + 1, F.length(longer))


def instability_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Microsatellite and repair-deficiency scores from indels, per group.

    ``msi``: 0.6 times the part of indels in homopolymers of three and more, plus
    0.4 times the indels of 1 to 4 bases per call. ``hrd``: 0.6 times deletions of
    6 to 50 bases plus 0.4 times insertions over 3, per indel. Zero without indels.
    """
    change, suffix = indel_changes(F.col("ref_allele"), F.col("alt_allele"))
    indel = F.col("_kind") == "Indel"
    size = F.abs("_change")
    rows = df.withColumn("_kind", variant_class(F.col("ref_allele"), F.col("alt_allele"))).withColumn("_change", change).withColumn("_suffix", suffix)
    n = lambda c: F.count(F.when(indel & c, 1))
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("n_calls"),
        F.count(F.when(indel, 1)).alias("n_indel"),
        n(F.col("_suffix").rlike(r"^(.)\1{2,}$")).alias("n_homopolymer"),
        n(size.between(1, 4)).alias("n_short"),
        n(F.col("_change").between(-50, -6)).alias("n_long_del"),
        n(F.col("_change") > 3).alias("n_ins"),
    )
    per_indel = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_indel")), F.lit(0.0))
    return counted.withColumn("msi", F.round(0.6 * per_indel("n_homopolymer") + 0.4 * F.col("n_short") / F.col("n_calls"), 6)).withColumn(
        "hrd", F.round(0.6 * per_indel("n_long_del") + 0.4 * per_indel("n_ins"), 6)
    )


def mutation_burden(df: DataFrame, by: list[str], *, megabases: float) -> DataFrame:
    """Calls per megabase: high from 10, intermediate from 1, else low."""
    rated = df.groupBy(*by).agg(F.count("*").alias("n_calls")).withColumn("tmb", F.round(F.col("n_calls") / megabases, 6))
    return rated.withColumn("class", F.when(F.col("tmb") >= 10, "high").when(F.col("tmb") >= 1, "intermediate").otherwise("low"))


def allelic_imbalance(df: DataFrame, by: list[str], *, least: int = 10) -> DataFrame:
    """Loss of heterozygosity: of frequencies in [0.15, 0.85], the median distance from
    one half and the part more than 0.15 away; flagged where the median is above 0.15."""
    away = F.abs(F.col("af").cast("double") - 0.5)
    het = df.filter(F.col("af").cast("double").between(0.15, 0.85) & ~F.isnan(F.col("af").cast("double"))).withColumn("_away", away)
    rated = het.groupBy(*by).agg(
        F.count("*").alias("n_het"), F.round(F.expr("percentile(_away, 0.5)"), 6).alias("median_skew"), F.round(F.avg((F.col("_away") > 0.15).cast("double")), 6).alias("skewed")
    )
    return rated.filter(F.col("n_het") >= least).withColumn("loh", F.col("median_skew") > 0.15)


def tumor_purity(df: DataFrame, by: list[str], *, least: int = 20) -> DataFrame:
    """Twice the mode of frequencies in (0.1, 0.85), by twenty bins (of equal ones the last)."""
    af = F.col("af").cast("double")
    binned = df.filter((af > 0.1) & (af < 0.85)).withColumn("_bin", af_bin(F.col("af"))).groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    mode = binned.groupBy(*by).agg(F.sum("_n").alias("n_calls"), F.max(F.struct("_n", "_bin")).alias("_top"))
    center = (F.col("_top._bin") + 0.5) / AF_BINS
    return mode.filter(F.col("n_calls") >= least).select(*by, "n_calls", F.round(F.least(2 * center, F.lit(1.0)), 6).alias("purity"))


def substitution_spectrum(df: DataFrame, by: list[str]) -> DataFrame:
    """The six substitution channels (pyrimidine reference), counts and fractions."""
    ref, alt = F.upper("ref_allele"), F.upper("alt_allele")
    flip = ref.isin("A", "G")
    channel = F.concat(F.when(flip, F.translate(ref, _BASES, _COMPLEMENTS)).otherwise(ref), F.lit(">"), F.when(flip, F.translate(alt, _BASES, _COMPLEMENTS)).otherwise(alt))
    snv = df.filter(ref.isin(*_BASES) & alt.isin(*_BASES) & (ref != alt)).select(*by, channel.alias("channel"))
    counted = snv.groupBy(*by, "channel").agg(F.count("*").alias("n_calls"))
    total = snv.groupBy(*by).agg(F.count("*").alias("_all"))
    joined = counted.join(total, by) if by else counted.crossJoin(total)
    return joined.select(*by, "channel", "n_calls", F.round(F.col("n_calls") / F.col("_all"), 6).alias("fraction"))
