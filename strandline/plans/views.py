"""Clean views of the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.tables import canonical_chrom, canonical_chrom_sql, table


def calls(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Variant calls, each once, chromosomes in their canonical form.

    With ``columns`` only these and the record's number are read and compared.
    """
    names = columns or ("sample_id", "cohort", "panel", "chrom", "pos", "ref_allele", "alt_allele", "qual", "af", "gene", "called_at")
    picked = [canonical_chrom("chrom").alias("chrom") if c == "chrom" else F.col(c) for c in names]
    return table(spark, sf_dir, "variants").select("record_id", *picked).distinct()


CALLS = f"""calls AS (
  SELECT DISTINCT record_id, sample_id, cohort, panel, {canonical_chrom_sql("chrom")} AS chrom, pos, ref_allele, alt_allele, qual, af, gene, called_at FROM variants)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid copy-number segments, each once."""
    return (
        table(spark, sf_dir, "cnv_segments")
        .select("segment_id", "profile_id", canonical_chrom("chrom").alias("chrom"), "start_pos", "end_pos", "copy_number", "cn_class", "gene", "log2_ratio")
        .filter(F.col("start_pos") < F.col("end_pos"))
        .distinct()
    )


SEGMENTS = f"""segments AS (
  SELECT DISTINCT segment_id, profile_id, {canonical_chrom_sql("chrom")} AS chrom, start_pos, end_pos, copy_number, cn_class, gene, log2_ratio
  FROM cnv_segments WHERE start_pos < end_pos)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid peaks, each once."""
    return (
        table(spark, sf_dir, "called_peaks")
        .select("peak_id", "run_id", canonical_chrom("chrom").alias("chrom"), "start_pos", "end_pos", "summit", "summit_height", "neg_log10_pvalue", "fold_enrichment")
        .filter((F.col("start_pos") < F.col("end_pos")) & F.col("chrom").isNotNull() & F.col("run_id").isNotNull())
        .distinct()
    )


PEAKS = f"""peaks AS (
  SELECT DISTINCT peak_id, run_id, {canonical_chrom_sql("chrom")} AS chrom, start_pos, end_pos, summit, summit_height, neg_log10_pvalue, fold_enrichment
  FROM called_peaks WHERE start_pos < end_pos AND {canonical_chrom_sql("chrom")} IS NOT NULL AND run_id IS NOT NULL)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid gene intervals, each once."""
    return (
        table(spark, sf_dir, "gene_intervals")
        .select("interval_id", canonical_chrom("chrom").alias("chrom"), "start_pos", "end_pos", "gene_id", "gene_name", "strand")
        .filter((F.col("start_pos") < F.col("end_pos")) & F.col("chrom").isNotNull() & F.col("gene_id").isNotNull())
        .distinct()
    )


GENES = f"""genes AS (
  SELECT DISTINCT interval_id, {canonical_chrom_sql("chrom")} AS chrom, start_pos, end_pos, gene_id, gene_name, strand
  FROM gene_intervals WHERE start_pos < end_pos AND {canonical_chrom_sql("chrom")} IS NOT NULL AND gene_id IS NOT NULL)"""


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression in long form: batch_id, gene_id, sample_no from 1, value (finite, not negative)."""
    rows = table(spark, sf_dir, "gene_expr").select("batch_id", "gene_id", "samples").filter(F.col("gene_id").isNotNull() & F.col("batch_id").isNotNull()).distinct()
    long = rows.select("batch_id", "gene_id", F.posexplode("samples").alias("_at", "value"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") < float("inf")) & (F.col("value") >= 0)
    return long.filter(finite).select("batch_id", "gene_id", (F.col("_at") + 1).alias("sample_no"), "value")


EXPRESSION = """expression AS (
  SELECT batch_id, gene_id, i AS sample_no, samples[i] AS value
  FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS i FROM (SELECT DISTINCT batch_id, gene_id, samples FROM gene_expr WHERE gene_id IS NOT NULL AND batch_id IS NOT NULL))
  WHERE isfinite(samples[i]) AND samples[i] >= 0)"""
