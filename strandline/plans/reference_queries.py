"""Queries of calls in the sequence around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import context, models
from strandline.plans.derived import MARGIN, TILE, as_file, reference_lines, sql_bases
from strandline.plans.views import CALLS, calls
from strandline.sources.text import read_fasta


def _flanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the flanks of a reference that is read from FASTA."""
    rows = calls(spark, sf_dir, "sample_id", "panel", "chrom", "pos", "ref_allele", "alt_allele").filter(F.col("chrom").isNotNull() & (F.col("pos") > 0))
    fasta = read_fasta(spark, as_file(reference_lines(rows), "reference"))
    name = F.split("name", ":")
    tiles = fasta.select(name[0].alias("chrom"), name[1].cast("long").alias("tile"), F.col("sequence").alias("bases"))
    return context.with_flanks(rows, tiles, width=TILE, margin=MARGIN)


def context_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions of each panel in the 96 channels of their context."""
    found = context.context_spectrum(_flanked(spark, sf_dir), ["panel"])
    return found.select("panel", F.col("channel").cast("long").alias("channel"), "label", "n_calls", F.round("fraction", 6).alias("fraction"))


def repair_with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair-deficiency score of each panel's indels, with the reference around them."""
    return context.repair_scores(_flanked(spark, sf_dir).filter(F.col("alt_allele").isNotNull() & F.col("ref_allele").isNotNull()), ["panel"]).withColumn("score", F.round("score", 6))


def context_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples' 96-channel spectra as mixtures of the panels' spectra."""
    rows = _flanked(spark, sf_dir)
    samples = context.context_spectrum(rows.filter(F.col("sample_id").isNotNull()), ["sample_id"])
    panels = context.context_spectrum(rows.filter(F.col("panel").isNotNull()), ["panel"])
    found = models.exposures(samples, panels, sample="sample_id", signature="panel")
    return found.select("sample_id", F.col("signature").alias("panel"), F.round("weight", 6).alias("weight"), F.round("cosine", 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (context_spectrum, repair_with_reference, context_exposures)}
_BASES = " || ".join(sql_bases(f"chrom || ':' || CAST(tile + {d} AS VARCHAR)") for d in range(-2, 3))
_FLANKED = f"""{CALLS}, placed AS (SELECT *, CAST(floor((pos - 1) / {TILE}) AS BIGINT) AS tile FROM calls WHERE chrom IS NOT NULL AND pos > 0),
  cut AS (SELECT *, {_BASES} AS bases, pos - 1 - tile * {TILE} + {MARGIN} AS k FROM placed),
  flanked AS (SELECT *, substr(bases, k - {MARGIN} + 1, {MARGIN}) AS b4, substr(bases, k + length(ref_allele) + 1, {MARGIN}) AS aft, upper(ref_allele) AS r, upper(alt_allele) AS a FROM cut)"""
_C = lambda x: f"translate({x}, 'ACGT', 'TGCA')"
SQL = {
    "context_spectrum": f"""WITH {_FLANKED},
      s AS (SELECT panel, r IN ('A', 'G') AS t, r, a, right(b4, 1) AS x, left(aft, 1) AS y FROM flanked WHERE r IN ('A', 'C', 'G', 'T') AND a IN ('A', 'C', 'G', 'T') AND r <> a),
      o AS (SELECT panel, CASE WHEN t THEN {_C("y")} ELSE x END AS f, CASE WHEN t THEN {_C("x")} ELSE y END AS g, CASE WHEN t THEN {_C("r")} || '>' || {_C("a")} ELSE r || '>' || a END AS kind FROM s),
      n AS (SELECT panel, f || '[' || kind || ']' || g AS label, count(*) AS n_calls FROM o GROUP BY ALL),
      e AS (SELECT panel, p * 24 + k * 4 + q AS channel, 'ACGT'[p + 1] || '[' || ['C>A', 'C>G', 'C>T', 'T>A', 'T>C', 'T>G'][k + 1] || ']' || 'ACGT'[q + 1] AS label
        FROM (SELECT DISTINCT panel FROM n), range(4) u(p), range(6) v(k), range(4) w(q))
      SELECT e.panel, channel, e.label, coalesce(n_calls, 0) AS n_calls, round(coalesce(n_calls, 0) / sum(coalesce(n_calls, 0)) OVER (PARTITION BY e.panel), 6) AS fraction
      FROM e LEFT JOIN n ON e.panel IS NOT DISTINCT FROM n.panel AND e.label = n.label""",
    "repair_with_reference": f"""WITH {_FLANKED},
      d AS (SELECT panel, length(r) - length(a) AS size, right(r, greatest(length(r) - length(a), 0)) AS del, right(upper(b4) || left(r, length(a)), greatest(length(r) - length(a), 0)) AS p,
        left(upper(aft), greatest(length(r) - length(a), 0)) AS q FROM flanked WHERE length(r) <> length(a)),
      m AS (SELECT panel, size, size > 0 AND len(list_filter(range(1, greatest(size, 0) + 1), lambda k: (k <= length(p) AND right(p, k) = left(del, k)) OR (k <= length(q) AND left(q, k) = right(del, k)))) > 0 AS mh FROM d),
      n AS (SELECT panel, count(*) AS n_indel, count(*) FILTER (size BETWEEN 6 AND 50) AS n_long_del, count(*) FILTER (size < -3) AS n_ins, count(*) FILTER (mh) AS n_like_ends FROM m GROUP BY panel),
      s AS (SELECT *, 0.7 * n_like_ends / n_indel + 0.3 * n_long_del / n_indel AS x FROM n)
      SELECT panel, n_indel, n_long_del, n_ins, n_like_ends, round(x, 6) AS score, CASE WHEN x > 0.25 THEN 'high' WHEN x >= 0.1 THEN 'intermediate' ELSE 'low' END AS class FROM s""",
}
