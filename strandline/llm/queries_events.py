"""Queries of the operators on events, identifiers and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.distinct import bitmaps_of, count_bitmaps, encode_ids, merge_bitmaps, shared_bitmaps
from strandline.llm.percentiles import merge_sketches, quantile_sketches, sketch_quantile
from strandline.llm.runs import collapse_runs
from strandline.session import checkpointed
from strandline.tables import canonical_chrom, canonical_chrom_sql, table


def _call_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(
        table(spark, sf_dir, "variants"),
        entity="sample_id",
        time="called_at",
        key="record_id",
        label=canonical_chrom("chrom"),
        position="pos",
        tolerance=2,
        least=2,
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of nearly the same call in a sample: first and last record."""
    return _call_runs(spark, sf_dir).select("sample_id", "first_record_id", "last_record_id")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs, each as one call with count and duration."""
    return _call_runs(spark, sf_dir).select(
        "sample_id", F.col("label").alias("chrom"), "first_position", "last_position", "n_events", "duration_us", "first_record_id"
    )


_RUNS_SQL = f"""
WITH calls AS (
  SELECT DISTINCT sample_id, record_id, called_at, {canonical_chrom_sql("chrom")} AS c, pos FROM variants WHERE sample_id IS NOT NULL),
steps AS (
  SELECT *, CASE WHEN c = lag(c) OVER w AND abs(pos - lag(pos) OVER w) <= 2 THEN 0 ELSE 1 END AS is_new
  FROM calls WINDOW w AS (PARTITION BY sample_id ORDER BY called_at, record_id)),
runs AS (
  SELECT *, sum(is_new) OVER (PARTITION BY sample_id ORDER BY called_at, record_id ROWS UNBOUNDED PRECEDING) AS run FROM steps),
ends AS (
  SELECT sample_id, run, count(*) AS n, arg_min(record_id, (called_at, record_id)) AS first_record_id, arg_max(record_id, (called_at, record_id)) AS last_record_id,
    arg_min(pos, (called_at, record_id)) AS first_position, arg_max(pos, (called_at, record_id)) AS last_position,
    min(c) AS chrom, epoch_us(max(called_at)) - epoch_us(min(called_at)) AS duration_us
  FROM runs GROUP BY sample_id, run HAVING count(*) >= 2)
"""
P1_SQL = _RUNS_SQL + "SELECT sample_id, first_record_id, last_record_id FROM ends"
P1_RUNS_SQL = _RUNS_SQL + "SELECT sample_id, chrom, first_position, last_position, n AS n_events, duration_us, first_record_id FROM ends"


def _position_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of the positions of each date, panel and cohort, on one dictionary of all positions."""
    calls = table(spark, sf_dir, "variants").select(
        F.to_date("called_at").alias("call_date"), "panel", "cohort", canonical_chrom("chrom").alias("chrom"), "pos"
    )
    dims = ["call_date", "panel", "cohort"]
    return checkpointed(bitmaps_of(encode_ids(calls, ["chrom", "pos"], dims), dims))


def p5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct positions per date, panel and cohort, ``ALL`` being any panel."""
    by_panel = _position_bitmaps(spark, sf_dir)
    one = count_bitmaps(by_panel, ["call_date", "panel", "cohort"], "n_positions")
    together = merge_bitmaps(by_panel, ["call_date", "cohort"])
    everything = count_bitmaps(together, ["call_date", "cohort"], "n_positions").withColumn("panel", F.lit("ALL"))
    return one.unionByName(everything).select(F.date_format("call_date", "yyyy-MM-dd").alias("call_date"), "panel", "cohort", "n_positions")


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct positions that both cohorts have on a date, per panel."""
    both = shared_bitmaps(_position_bitmaps(spark, sf_dir).filter(F.col("cohort").isin("case", "control")), ["call_date", "panel"], of=2)
    counted = count_bitmaps(both, ["call_date", "panel"], "n_shared").filter("n_shared > 0")
    return counted.select(F.date_format("call_date", "yyyy-MM-dd").alias("call_date"), "panel", "n_shared")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported unique positions that are off the true number by more than 5 %."""
    true = p5_positions(spark, sf_dir)
    reports = table(spark, sf_dir, "comparisons").select(
        "comparison_id",
        F.date_format("call_date", "yyyy-MM-dd").alias("call_date"),
        "panel",
        F.explode(
            F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_unique_positions").alias("_reported")) for side in ("case", "control")])
        ).alias("_x"),
    )
    reports = reports.select("comparison_id", "call_date", "panel", "_x.*").filter(F.col("_reported").isNotNull())
    counted = reports.join(true.withColumnRenamed("cohort", "side"), ["call_date", "panel", "side"], "left")
    n = F.coalesce("n_positions", F.lit(0))
    return counted.filter(F.abs(F.col("_reported") - n) > 0.05 * n).select("comparison_id", "side").distinct()


_POSITIONS_SQL = f"""
WITH calls AS (
  SELECT CAST(called_at AS DATE) AS call_date, panel, cohort, {canonical_chrom_sql("chrom")} AS c, pos FROM variants),
counted AS (
  SELECT call_date, panel, cohort, count(DISTINCT (c, pos)) FILTER (c IS NOT NULL AND pos IS NOT NULL) AS n_positions FROM calls GROUP BY ALL
  UNION ALL
  SELECT call_date, 'ALL', cohort, count(DISTINCT (c, pos)) FILTER (c IS NOT NULL AND pos IS NOT NULL) FROM calls GROUP BY ALL)
"""
P5_POSITIONS_SQL = _POSITIONS_SQL + "SELECT strftime(call_date, '%Y-%m-%d') AS call_date, panel, cohort, CAST(n_positions AS BIGINT) AS n_positions FROM counted WHERE n_positions > 0"
P5_SHARED_SQL = f"""
WITH calls AS (
  SELECT DISTINCT CAST(called_at AS DATE) AS call_date, panel, cohort, {canonical_chrom_sql("chrom")} AS c, pos FROM variants WHERE cohort IN ('case', 'control')),
both_sides AS (SELECT call_date, panel, c, pos FROM calls WHERE c IS NOT NULL AND pos IS NOT NULL GROUP BY ALL HAVING count(*) = 2)
SELECT strftime(call_date, '%Y-%m-%d') AS call_date, panel, count(*) AS n_shared FROM both_sides GROUP BY ALL
"""
P5_SQL = (
    _POSITIONS_SQL
    + """, reports AS (
  SELECT comparison_id, call_date, panel, 'case' AS side, case_unique_positions AS reported FROM comparisons
  UNION ALL SELECT comparison_id, call_date, panel, 'control', control_unique_positions FROM comparisons)
SELECT DISTINCT comparison_id, r.side FROM reports r
LEFT JOIN counted t ON r.call_date = t.call_date AND r.panel = t.panel AND r.side = t.cohort
WHERE reported IS NOT NULL AND abs(reported - coalesce(n_positions, 0)) > 0.05 * coalesce(n_positions, 0)
"""
)


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all measures: entity, measure, value; redelivered rows once."""
    peaks = table(spark, sf_dir, "called_peaks").select("peak_id", "run_id", "start_pos", "end_pos", "fold_enrichment").distinct()
    width, fold = F.col("end_pos") - F.col("start_pos"), F.col("fold_enrichment")
    of_peaks = peaks.select(
        F.col("run_id").alias("entity"),
        F.explode(
            F.array(
                F.struct(F.lit("median_peak_width").alias("measure"), F.when(width > 0, width.cast("double")).alias("value")),
                F.struct(F.lit("median_fold_enrichment").alias("measure"), F.when(fold > 0, fold).alias("value")),
            )
        ).alias("_x"),
    ).select("entity", "_x.*")
    genes = table(spark, sf_dir, "gene_expr").groupBy("batch_id", "gene_id").agg(F.first("samples").alias("samples"))
    of_genes = genes.select(F.col("batch_id").alias("entity"), F.lit("batch_median").alias("measure"), F.explode("samples").alias("value"))
    return of_peaks.unionByName(of_genes.filter(F.col("value") >= 0)).filter(F.col("value").isNotNull())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported medians that are off the true one by more than 5 %."""
    medians = quantile_sketches(_measures(spark, sf_dir), dims=["entity", "measure"], value="value").select(
        "entity", "measure", sketch_quantile(0.5).alias("_true")
    )
    summaries = table(spark, sf_dir, "peak_summaries").select(
        F.col("run_id").alias("entity"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("_reported")) for m in ("median_peak_width", "median_fold_enrichment")])
        ).alias("_x"),
    )
    batches = table(spark, sf_dir, "gene_expr").select(F.col("batch_id").alias("entity"), F.lit("batch_median").alias("measure"), F.col("batch_median").alias("_reported"))
    reports = summaries.select("entity", "_x.*").unionByName(batches.distinct()).filter(F.col("_reported").isNotNull())
    off = F.abs(F.col("_reported") - F.col("_true")) > 0.05 * F.abs("_true")
    return reports.join(medians, ["entity", "measure"]).filter(off | F.isnan("_reported")).select("entity", "measure").distinct()


def p6_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and the ninetieth percentile of the peak widths of each run, from sketches
    of its chromosomes that are merged."""
    peaks = table(spark, sf_dir, "called_peaks").select("peak_id", "run_id", canonical_chrom("chrom").alias("chrom"), (F.col("end_pos") - F.col("start_pos")).alias("width")).distinct()
    parts = quantile_sketches(peaks.filter("width > 0"), dims=["run_id", "chrom"], value="width")
    return merge_sketches(parts, ["run_id"]).select("run_id", "n", *[sketch_quantile(q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)])


P6_QUARTILES_SQL = f"""
WITH peaks AS (SELECT DISTINCT peak_id, run_id, {canonical_chrom_sql("chrom")} AS chrom, end_pos - start_pos AS width FROM called_peaks),
o AS (SELECT run_id, list_sort(list(CAST(width AS DOUBLE))) AS v, count(*) AS n FROM peaks WHERE width > 0 GROUP BY run_id)
SELECT run_id, n, {", ".join(f"(v[CAST(ceil({q} * n) AS BIGINT)] + v[least(n, CAST(floor({q} * n) AS BIGINT) + 1)]) / 2 AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9))} FROM o
"""
P6_SQL = """
WITH peaks AS (SELECT DISTINCT peak_id, run_id, start_pos, end_pos, fold_enrichment FROM called_peaks),
genes AS (SELECT DISTINCT batch_id, gene_id, samples FROM gene_expr),
vals AS (
  SELECT run_id AS entity, 'median_peak_width' AS measure, CAST(end_pos - start_pos AS DOUBLE) AS value FROM peaks WHERE end_pos > start_pos
  UNION ALL SELECT run_id, 'median_fold_enrichment', fold_enrichment FROM peaks WHERE isfinite(fold_enrichment) AND fold_enrichment > 0
  UNION ALL SELECT batch_id, 'batch_median', v FROM (SELECT batch_id, unnest(samples) AS v FROM genes) WHERE isfinite(v) AND v >= 0),
medians AS (SELECT entity, measure, median(value) AS truth FROM vals GROUP BY entity, measure),
reports AS (
  SELECT run_id AS entity, 'median_peak_width' AS measure, median_peak_width AS reported FROM peak_summaries
  UNION ALL SELECT run_id, 'median_fold_enrichment', median_fold_enrichment FROM peak_summaries
  UNION ALL SELECT DISTINCT batch_id, 'batch_median', batch_median FROM gene_expr)
SELECT DISTINCT entity, measure FROM reports JOIN medians USING (entity, measure)
WHERE reported IS NOT NULL AND abs(reported - truth) > 0.05 * abs(truth)
"""

QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p5_found": p5_found, "p5_positions": p5_positions, "p5_shared": p5_shared, "p6_found": p6_found, "p6_quartiles": p6_quartiles}
SQL = {"p1_found": P1_SQL, "p1_runs": P1_RUNS_SQL, "p5_found": P5_SQL, "p5_positions": P5_POSITIONS_SQL, "p5_shared": P5_SHARED_SQL, "p6_found": P6_SQL, "p6_quartiles": P6_QUARTILES_SQL}
