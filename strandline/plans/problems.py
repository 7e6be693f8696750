"""The queries of the core's data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.fields import segment_fields
from strandline.operators.intervals import periods_and_gaps
from strandline.operators.loading import good_records, parse_lines, rejected_lines
from strandline.session import checkpointed
from strandline.tables import canonical_chrom, canonical_chrom_sql, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of CNV profiles and of genes, per chromosome."""
    both = None
    for name, entity in (("cnv_segments", "profile_id"), ("gene_intervals", "gene_id")):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(entity).alias("entity"), canonical_chrom("chrom").alias("chrom"), "start_pos", "end_pos")
        both = rows if both is None else both.unionByName(rows)
    return periods_and_gaps(both, entity=["tbl", "entity", "chrom"])


P3_SQL = f"""
WITH rows AS (
  SELECT DISTINCT 'cnv_segments' AS tbl, profile_id AS entity, {canonical_chrom_sql("chrom")} AS chrom, start_pos, end_pos FROM cnv_segments
  UNION ALL
  SELECT DISTINCT 'gene_intervals', gene_id, {canonical_chrom_sql("chrom")}, start_pos, end_pos FROM gene_intervals),
reach AS (
  SELECT *, max(end_pos) OVER (PARTITION BY tbl, entity, chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM rows WHERE start_pos < end_pos),
numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR start_pos > before THEN 1 ELSE 0 END) OVER (PARTITION BY tbl, entity, chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS n
  FROM reach),
periods AS (
  SELECT tbl, entity, chrom, n, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM numbered GROUP BY tbl, entity, chrom, n),
gaps AS (
  SELECT tbl, entity, chrom, lag(end_pos) OVER (PARTITION BY tbl, entity, chrom ORDER BY n) AS start_pos, start_pos AS end_pos FROM periods)
SELECT tbl, entity, chrom, 'period' AS kind, start_pos, end_pos FROM periods
UNION ALL
SELECT tbl, entity, chrom, 'gap' AS kind, start_pos, end_pos FROM gaps WHERE start_pos IS NOT NULL
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of packed alternative alleles and genes, one a row."""
    return segment_fields(table(spark, sf_dir, "variants"), key=["record_id"], fields=["alt_allele", "gene"])


#: Value characters and their complement as RE2 classes.
_VALUE = r"[\p{L}\p{N}\-._:<>\[\]*]"
_SEPARATOR = r"[^\p{L}\p{N}\-._:<>\[\]*\s]"
_TOKENS = rf"(?:\"[^\"]*\"|''[^'']*''|{_VALUE})+|\s*{_SEPARATOR}\s*|\s+"
P4_SQL = rf"""
WITH fields AS (
  SELECT DISTINCT record_id, 'alt_allele' AS field_name, alt_allele AS txt FROM variants
  UNION ALL
  SELECT DISTINCT record_id, 'gene', gene FROM variants),
tokens AS (
  SELECT record_id, field_name, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
  FROM (SELECT record_id, field_name, regexp_extract_all(regexp_replace(txt, '^\s+|\s+$', '', 'g'), '{_TOKENS}') AS toks FROM fields WHERE txt IS NOT NULL)),
placed AS (
  SELECT *, regexp_matches(tok, '^(?:["'']|{_VALUE})') AS is_value,
    1 + sum(CASE WHEN regexp_matches(tok, '^(?:["'']|{_VALUE})') THEN 0 ELSE 1 END) OVER (PARTITION BY record_id, field_name ORDER BY i) AS value_no
  FROM tokens),
items AS (
  SELECT record_id, field_name, value_no, regexp_replace(tok, '"([^"]*)"|''([^'']*)''', '\1\2', 'g') AS item FROM placed WHERE is_value)
SELECT record_id, field_name, CAST(value_no AS INTEGER) AS value_no, item FROM items
WHERE item <> '' QUALIFY count(*) OVER (PARTITION BY record_id, field_name) > 1
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fail to parse, with the reason."""
    parsed = parse_lines(table(spark, sf_dir, "raw_lines"))
    return rejected_lines(parsed).select("line_id", "reason").distinct()


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines by format: how many, and the sums of their typed columns."""
    parsed = checkpointed(parse_lines(table(spark, sf_dir, "raw_lines")))
    peaks = good_records(parsed, "narrowpeak").agg(F.lit("narrowpeak").alias("fmt"), F.count("*").alias("n_good"), F.round(F.sum("signal"), 3).alias("total"), F.sum(F.col("end") - F.col("start")).alias("span"))
    calls = good_records(parsed, "vcf").agg(F.lit("vcf").alias("fmt"), F.count("*").alias("n_good"), F.round(F.sum("qual"), 3).alias("total"), F.sum("pos").alias("span"))
    sets = good_records(parsed, "gmt").agg(F.lit("gmt").alias("fmt"), F.count("*").alias("n_good"), F.lit(None).cast("double").alias("total"), F.sum(F.size("genes")).cast("long").alias("span"))
    return peaks.unionByName(calls).unionByName(sets).filter("n_good > 0")


_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
P7_PARSED_SQL = rf"""
WITH lines AS (
  SELECT line_id, fmt, regexp_replace(line_text, '\r$', '') AS txt FROM raw_lines),
data AS (
  SELECT *, NOT regexp_full_match(txt, '{_FIELD}(?:\t{_FIELD})*') AS misquoted
  FROM lines WHERE regexp_matches(txt, '\S') AND NOT starts_with(txt, '#')
    AND NOT (fmt = 'narrowpeak' AND (starts_with(txt, 'track') OR starts_with(txt, 'browser')))),
parted AS (
  SELECT line_id, fmt, misquoted, list_transform(regexp_extract_all(chr(9) || txt, '\t("(?:[^"]|"")*"|[^\t]*)', 1),
    lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f
  FROM data),
judged AS (
  SELECT *, CASE
    WHEN misquoted THEN 'quoting'
    WHEN (fmt = 'narrowpeak' AND len(f) <> 10) OR (fmt = 'vcf' AND len(f) <> 8) OR (fmt = 'gmt' AND len(f) < 3) THEN 'column_count'
    WHEN fmt = 'narrowpeak' AND coalesce(
      f[1] <> '' AND regexp_matches(f[2], '^[0-9]+$') AND regexp_matches(f[3], '^[0-9]+$') AND TRY_CAST(f[2] AS HUGEINT) < TRY_CAST(f[3] AS HUGEINT)
      AND regexp_matches(f[5], '^[0-9]+$') AND TRY_CAST(f[5] AS HUGEINT) <= 1000 AND f[6] IN ('+', '-', '.')
      AND regexp_matches(f[7], '{_NUMBER}') AND regexp_matches(f[8], '{_NUMBER}') AND regexp_matches(f[9], '{_NUMBER}')
      AND (f[10] = '-1' OR (regexp_matches(f[10], '^[0-9]+$') AND TRY_CAST(f[10] AS HUGEINT) < TRY_CAST(f[3] AS HUGEINT) - TRY_CAST(f[2] AS HUGEINT))), false) THEN NULL
    WHEN fmt = 'vcf' AND coalesce(
      f[1] <> '' AND f[4] <> '' AND f[5] <> '' AND regexp_matches(f[2], '^[0-9]+$') AND TRY_CAST(f[2] AS HUGEINT) > 0
      AND (f[6] = '.' OR (regexp_matches(f[6], '{_NUMBER}') AND TRY_CAST(f[6] AS DOUBLE) >= 0)), false) THEN NULL
    WHEN fmt = 'gmt' AND f[1] <> '' AND NOT regexp_matches(f[2], '[\x00-\x08\x0a-\x1f\x7f\x{{80}}-\x{{9f}}\x{{fffd}}]') THEN NULL
    ELSE 'invalid_value' END AS reason
  FROM parted)
"""
P7_SQL = P7_PARSED_SQL + "SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL"
P7_RECORDS_SQL = (
    P7_PARSED_SQL
    + """
SELECT fmt, count(*) AS n_good,
  round(sum(CASE fmt WHEN 'narrowpeak' THEN TRY_CAST(f[7] AS DOUBLE) WHEN 'vcf' THEN TRY_CAST(f[6] AS DOUBLE) END), 3) AS total,
  CAST(sum(CASE fmt WHEN 'narrowpeak' THEN TRY_CAST(f[3] AS BIGINT) - TRY_CAST(f[2] AS BIGINT) WHEN 'vcf' THEN TRY_CAST(f[2] AS BIGINT) ELSE len(f) - 2 END) AS BIGINT) AS span
FROM judged WHERE reason IS NULL GROUP BY fmt
"""
)

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p7_found": p7_found, "p7_records": p7_records}
SQL = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p7_records": P7_RECORDS_SQL}
