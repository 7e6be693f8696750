"""Queries that fold streams of the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.streaming.folds import fold_calls, fold_peaks, fold_segments, fold_sites, run_available, sessions, stream_table
from strandline.tables import canonical_chrom_sql, table


def streamed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of variants by chromosome, folded as a stream."""
    out = run_available(fold_calls(stream_table(spark, sf_dir, "variants")))
    return out.select("chrom", "n_rows", "n_high")


def streamed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of called_peaks by run, folded as a stream."""
    return run_available(fold_peaks(stream_table(spark, sf_dir, "called_peaks")))


def streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cnv_segments by profile, folded as a stream."""
    return run_available(fold_segments(stream_table(spark, sf_dir, "cnv_segments")))


def streamed_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele frequencies by cohort and panel, folded as a stream."""
    return run_available(fold_sites(stream_table(spark, sf_dir, "variants"), by=["cohort", "panel"], value="af"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, half an hour of silence between them."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = sessions(rows, user="user_id", time="ts", gap="30 minutes", late="1 hour")
    micros = lambda c: F.unix_micros(c)
    return found.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n_events", "total")


QUERIES = {f.__name__: f for f in (streamed_calls, streamed_peaks, streamed_segments, streamed_frequencies, user_sessions)}
SQL = {
    "streamed_calls": f"SELECT {canonical_chrom_sql('chrom')} AS chrom, count(*) AS n_rows, count(*) FILTER (qual > 30) AS n_high FROM variants GROUP BY 1",
    "streamed_peaks": """WITH w AS (SELECT *, CASE WHEN end_pos > start_pos THEN end_pos - start_pos END AS w FROM called_peaks)
      SELECT run_id, count(*) AS n_rows, CAST(sum(w) AS BIGINT) AS n_bases, count(*) FILTER (w < 500) AS n_narrow, max(summit_height) AS best_height FROM w GROUP BY run_id""",
    "streamed_segments": """WITH w AS (SELECT *, CASE WHEN end_pos > start_pos THEN end_pos - start_pos END AS w FROM cnv_segments)
      SELECT profile_id, count(*) AS n_rows, CAST(sum(w) AS BIGINT) AS n_bases, round(sum(CAST(copy_number AS DOUBLE) * w) / 1e6, 3) AS copy_megabases FROM w GROUP BY profile_id""",
    "streamed_frequencies": """WITH v AS (SELECT cohort, panel, CASE WHEN NOT isnan(af) THEN CAST(af AS DOUBLE) END AS v FROM variants)
      SELECT cohort, panel, count(v) AS n_sites, round(sum(v), 3) AS total, round(sum(v * v), 3) AS squares FROM v GROUP BY cohort, panel""",
    "user_sessions": """WITH s AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true) THEN 1 ELSE 0 END AS n FROM events WHERE ts IS NOT NULL),
      g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
      SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n_events, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""",
}
