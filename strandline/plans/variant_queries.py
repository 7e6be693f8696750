"""Queries over variant calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import variants as V
from strandline.plans.views import CALLS, calls

#: Both alleles' lengths and bases, as the class of a call.
_CLASS_SQL = """CASE
  WHEN length(r) <> length(b) THEN 'Indel' WHEN length(r) <> 1 THEN 'Other'
  WHEN r || b IN ('AG', 'GA', 'CT', 'TC') THEN 'Transition'
  WHEN r IN ('A', 'C', 'G', 'T') AND b IN ('A', 'C', 'G', 'T') THEN 'Transversion' WHEN r || b IS NOT NULL THEN 'Other' END"""
_CLASSED = f"""WITH {CALLS},
lengths AS (
  SELECT *, upper(ref_allele) AS r, CASE WHEN length(ref_allele) = 1 AND length(alt_allele) > 1 THEN split_part(upper(alt_allele), ',', 1) ELSE upper(alt_allele) END AS b FROM calls),
classed AS (SELECT *, {_CLASS_SQL} AS kind FROM lengths)"""
_COUNTS_SQL = """count(*) AS n_calls, count(*) FILTER (kind IN ('Transition', 'Transversion')) AS n_snp, count(*) FILTER (kind = 'Indel') AS n_indel,
  count(*) FILTER (kind = 'Transition') AS n_ts, count(*) FILTER (kind = 'Transversion') AS n_tv, count(*) FILTER (qual > 30) AS n_high,
  round(CASE WHEN count(*) FILTER (kind = 'Transversion') > 0 THEN count(*) FILTER (kind = 'Transition') / count(*) FILTER (kind = 'Transversion') ELSE 0 END, 6) AS titv"""


def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls in one row."""
    rows = calls(spark, sf_dir, "ref_allele", "alt_allele", "qual", "chrom", "pos", "gene")
    return V.summarize_variants(rows, []).crossJoin(V.distinct_sites(rows, []))


def variant_summary_by_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by chromosome."""
    return V.summarize_variants(calls(spark, sf_dir, "ref_allele", "alt_allele", "qual", "chrom"), ["chrom"])


def variant_summary_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by sample and cohort."""
    return V.summarize_variants(calls(spark, sf_dir, "ref_allele", "alt_allele", "qual", "cohort", "sample_id"), ["cohort", "sample_id"])


def variant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the class of their alleles."""
    return calls(spark, sf_dir, "ref_allele", "alt_allele").groupBy(V.variant_class(F.col("ref_allele"), F.col("alt_allele")).alias("kind")).agg(F.count("*").alias("n_calls"))


def allele_frequency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bins of allele frequency, by cohort."""
    return V.af_histogram(calls(spark, sf_dir, "af", "cohort"), ["cohort"])


def high_quality_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred genes with the most calls above quality 30."""
    high = calls(spark, sf_dir, "qual", "gene").filter((F.col("qual") > 30) & (F.col("gene") != ""))
    return high.groupBy("gene").agg(F.count("*").alias("n_calls")).orderBy(F.desc("n_calls"), "gene").limit(100)


def instability_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indel-based instability scores of each sample."""
    return V.instability_scores(calls(spark, sf_dir, "ref_allele", "alt_allele", "sample_id"), ["sample_id"])


def burden_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per megabase over an exome of 35 megabases."""
    return V.mutation_burden(calls(spark, sf_dir, "sample_id"), ["sample_id"], megabases=35.0)


def imbalance_by_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of heterozygosity by cohort and chromosome."""
    return V.allelic_imbalance(calls(spark, sf_dir, "af", "cohort", "chrom"), ["cohort", "chrom"])


def purity_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumour purity of each sample."""
    return V.tumor_purity(calls(spark, sf_dir, "af", "sample_id"), ["sample_id"])


def substitution_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-channel spectrum by cohort."""
    return V.substitution_spectrum(calls(spark, sf_dir, "ref_allele", "alt_allele", "cohort"), ["cohort"])


def case_control_by_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of calls on each chromosome, cases against controls."""
    rows = calls(spark, sf_dir, "chrom", "cohort").filter(F.col("chrom").isNotNull())
    sides = rows.groupBy("chrom").agg(*[F.count(F.when(F.col("cohort") == s, 1)).alias(f"n_{s}") for s in ("case", "control")])
    total = rows.agg(*[F.count(F.when(F.col("cohort") == s, 1)).alias(f"_{s}") for s in ("case", "control")])
    delta = F.round(F.col("n_case") / F.col("_case") - F.col("n_control") / F.col("_control"), 6)
    return sides.crossJoin(total).select("chrom", "n_case", "n_control", delta.alias("delta_share"))


def gained_and_lost_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most called genes of cases and of controls: gained, lost, shared."""
    rows = calls(spark, sf_dir, "gene", "cohort").filter(F.col("gene") != "")
    top = lambda side: rows.filter(F.col("cohort") == side).groupBy("gene").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "gene").limit(100).select("gene")
    both = top("case").withColumn("_a", F.lit(True)).join(top("control").withColumn("_b", F.lit(True)), "gene", "full_outer")
    return both.select("gene", F.when(F.col("_b").isNull(), "gained").when(F.col("_a").isNull(), "lost").otherwise("shared").alias("change"))


def tumor_against_germline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites called in the tumour and the germline panel alike: calls and mean frequencies."""
    rows = calls(spark, sf_dir, "chrom", "pos", "panel", "af").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    site = lambda panel, name: (
        rows.filter(F.col("panel") == panel).groupBy("chrom", "pos").agg(F.count("*").alias(f"n_{name}"), F.round(F.avg(F.nanvl(F.col("af").cast("double"), F.lit(None).cast("double"))), 5).alias(f"af_{name}"))
    )
    return site("tumor", "tumor").join(site("germline", "germline"), ["chrom", "pos"])


QUERIES = {
    f.__name__: f
    for f in (
        variant_summary,
        variant_summary_by_chrom,
        variant_summary_by_sample,
        variant_classes,
        allele_frequency_histogram,
        high_quality_genes,
        instability_by_sample,
        burden_by_sample,
        imbalance_by_chrom,
        purity_by_sample,
        substitution_spectrum,
        case_control_by_chrom,
        gained_and_lost_genes,
        tumor_against_germline,
    )
}
_SUFFIX = "CASE WHEN length(alt_allele) > length(ref_allele) THEN substr(alt_allele, length(ref_allele) + 1) ELSE substr(ref_allele, length(alt_allele) + 1) END"
_BIN = "CAST(greatest(0, least(19, floor(CAST(af AS DOUBLE) * 20))) AS INTEGER)"
SQL = {
    "variant_summary": f"""{_CLASSED} SELECT {_COUNTS_SQL}, count(DISTINCT (chrom, pos)) FILTER (chrom IS NOT NULL AND pos IS NOT NULL) AS n_sites,
      count(DISTINCT gene) FILTER (gene <> '') AS n_genes FROM classed""",
    "variant_summary_by_chrom": f"{_CLASSED} SELECT chrom, {_COUNTS_SQL} FROM classed GROUP BY chrom",
    "variant_summary_by_sample": f"{_CLASSED} SELECT cohort, sample_id, {_COUNTS_SQL} FROM classed GROUP BY cohort, sample_id",
    "variant_classes": f"{_CLASSED} SELECT kind, count(*) AS n_calls FROM classed GROUP BY kind",
    "allele_frequency_histogram": f"WITH {CALLS} SELECT cohort, {_BIN} AS bin, count(*) AS n_calls FROM calls WHERE af IS NOT NULL AND NOT isnan(af) GROUP BY ALL",
    "high_quality_genes": f"WITH {CALLS} SELECT gene, count(*) AS n_calls FROM calls WHERE qual > 30 AND gene <> '' GROUP BY gene ORDER BY n_calls DESC, gene LIMIT 100",
    "instability_by_sample": f"""{_CLASSED}, counted AS (
      SELECT sample_id, count(*) AS n_calls, count(*) FILTER (kind = 'Indel') AS n_indel,
        count(*) FILTER (kind = 'Indel' AND length({_SUFFIX}) >= 3 AND replace({_SUFFIX}, {_SUFFIX}[1], '') = '') AS n_homopolymer,
        count(*) FILTER (kind = 'Indel' AND abs(length(alt_allele) - length(ref_allele)) BETWEEN 1 AND 4) AS n_short,
        count(*) FILTER (kind = 'Indel' AND length(alt_allele) - length(ref_allele) BETWEEN -50 AND -6) AS n_long_del,
        count(*) FILTER (kind = 'Indel' AND length(alt_allele) - length(ref_allele) > 3) AS n_ins FROM classed GROUP BY sample_id)
      SELECT *, round(0.6 * coalesce(n_homopolymer / nullif(n_indel, 0), 0) + 0.4 * n_short / n_calls, 6) AS msi,
        round(0.6 * coalesce(n_long_del / nullif(n_indel, 0), 0) + 0.4 * coalesce(n_ins / nullif(n_indel, 0), 0), 6) AS hrd FROM counted""",
    "burden_by_sample": f"""WITH {CALLS}, rated AS (SELECT sample_id, count(*) AS n_calls, round(count(*) / 35.0, 6) AS tmb FROM calls GROUP BY sample_id)
      SELECT *, CASE WHEN tmb >= 10 THEN 'high' WHEN tmb >= 1 THEN 'intermediate' ELSE 'low' END AS class FROM rated""",
    "imbalance_by_chrom": f"""WITH {CALLS}, het AS (
      SELECT cohort, chrom, abs(CAST(af AS DOUBLE) - 0.5) AS away FROM calls WHERE CAST(af AS DOUBLE) BETWEEN 0.15 AND 0.85 AND NOT isnan(af)),
      rated AS (SELECT cohort, chrom, count(*) AS n_het, round(median(away), 6) AS median_skew, round(avg(CASE WHEN away > 0.15 THEN 1.0 ELSE 0.0 END), 6) AS skewed
        FROM het GROUP BY cohort, chrom HAVING count(*) >= 10)
      SELECT *, median_skew > 0.15 AS loh FROM rated""",
    "purity_by_sample": f"""WITH {CALLS}, binned AS (
      SELECT sample_id, {_BIN} AS bin, count(*) AS n FROM calls WHERE CAST(af AS DOUBLE) > 0.1 AND CAST(af AS DOUBLE) < 0.85 GROUP BY ALL)
      SELECT sample_id, CAST(sum(n) AS BIGINT) AS n_calls, round(least(2 * (max_by(bin, n * 100 + bin) + 0.5) / 20, 1.0), 6) AS purity FROM binned GROUP BY sample_id HAVING sum(n) >= 20""",
    "substitution_spectrum": f"""WITH {CALLS}, snv AS (
      SELECT cohort, CASE WHEN upper(ref_allele) IN ('A', 'G') THEN translate(upper(ref_allele), 'ACGT', 'TGCA') || '>' || translate(upper(alt_allele), 'ACGT', 'TGCA')
        ELSE upper(ref_allele) || '>' || upper(alt_allele) END AS channel FROM calls
      WHERE upper(ref_allele) IN ('A', 'C', 'G', 'T') AND upper(alt_allele) IN ('A', 'C', 'G', 'T') AND upper(ref_allele) <> upper(alt_allele))
      SELECT cohort, channel, count(*) AS n_calls, round(count(*) / sum(count(*)) OVER (PARTITION BY cohort), 6) AS fraction FROM snv GROUP BY cohort, channel""",
    "case_control_by_chrom": f"""WITH {CALLS}, sides AS (
      SELECT chrom, count(*) FILTER (cohort = 'case') AS n_case, count(*) FILTER (cohort = 'control') AS n_control FROM calls WHERE chrom IS NOT NULL GROUP BY chrom)
      SELECT chrom, n_case, n_control, round(n_case / sum(n_case) OVER () - n_control / sum(n_control) OVER (), 6) AS delta_share FROM sides""",
    "gained_and_lost_genes": f"""WITH {CALLS},
      a AS (SELECT gene FROM calls WHERE gene <> '' AND cohort = 'case' GROUP BY gene ORDER BY count(*) DESC, gene LIMIT 100),
      b AS (SELECT gene FROM calls WHERE gene <> '' AND cohort = 'control' GROUP BY gene ORDER BY count(*) DESC, gene LIMIT 100)
      SELECT coalesce(a.gene, b.gene) AS gene, CASE WHEN b.gene IS NULL THEN 'gained' WHEN a.gene IS NULL THEN 'lost' ELSE 'shared' END AS change FROM a FULL JOIN b ON a.gene = b.gene""",
    "tumor_against_germline": f"""WITH {CALLS}, sites AS (
      SELECT panel, chrom, pos, count(*) AS n, round(avg(CAST(CASE WHEN isnan(af) THEN NULL ELSE af END AS DOUBLE)), 5) AS af FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL GROUP BY ALL)
      SELECT t.chrom, t.pos, t.n AS n_tumor, t.af AS af_tumor, g.n AS n_germline, g.af AS af_germline FROM sites t JOIN sites g ON t.chrom = g.chrom AND t.pos = g.pos AND t.panel = 'tumor' AND g.panel = 'germline'""",
}
