"""Queries over segments, peaks and gene intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import copynumber as C
from strandline.operators import overlap as O
from strandline.operators.intervals import periods_and_gaps
from strandline.plans.views import CALLS, GENES, PEAKS, SEGMENTS, calls, genes, peaks, segments

#: Bases below which a segment is merged with its neighbour.
SMALL = 2_000_000
_GENE_SPAN = ("gene_start", "gene_end")


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes(spark, sf_dir).select("interval_id", "chrom", F.col("start_pos").alias("gene_start"), F.col("end_pos").alias("gene_end"), "gene_id")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir, "chrom", "pos", "cohort", "sample_id").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    return rows.select("record_id", "cohort", "sample_id", "chrom", "pos", (F.col("pos") + 1).alias("pos_end"))


def peaks_in_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks over each gene: how many, how many bases, zero where none."""
    found = O.overlap_join(peaks(spark, sf_dir), _genes(spark, sf_dir), left_span=("start_pos", "end_pos"), right_span=_GENE_SPAN)
    shared = F.least("end_pos", "gene_end") - F.greatest("start_pos", "gene_start")
    hits = found.groupBy("interval_id").agg(F.count("*").alias("n"), F.sum(shared).alias("b"))
    every = _genes(spark, sf_dir).select("interval_id", "gene_id")
    return every.join(hits, "interval_id", "left").select("interval_id", "gene_id", F.coalesce("n", F.lit(0)).alias("n_peaks"), F.coalesce("b", F.lit(0)).alias("shared_bases"))


def first_gene_of_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gene, by start, that each peak touches."""
    found = O.overlap_join(peaks(spark, sf_dir), _genes(spark, sf_dir), left_span=("start_pos", "end_pos"), right_span=_GENE_SPAN)
    return found.groupBy("peak_id").agg(F.min(F.struct("gene_start", "gene_id")).alias("_x"), F.count_distinct("gene_id").alias("n_genes")).select(
        "peak_id", F.col("_x.gene_id").alias("gene_id"), "n_genes"
    )


def calls_in_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls within each gene, by cohort."""
    found = O.overlap_join(_sites(spark, sf_dir), _genes(spark, sf_dir), left_span=("pos", "pos_end"), right_span=_GENE_SPAN)
    return found.select("gene_id", "cohort", "record_id").distinct().groupBy("gene_id", "cohort").agg(F.count("*").alias("n_calls"))


def calls_outside_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls outside of all genes, by chromosome."""
    outside = O.overlap_join(_sites(spark, sf_dir), _genes(spark, sf_dir), left_span=("pos", "pos_end"), right_span=_GENE_SPAN, how="left_anti")
    return outside.groupBy("chrom").agg(F.count("*").alias("n_calls"))


def merged_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping peaks of a run as one, with the highest summit."""
    return O.merge_keeping_best(peaks(spark, sf_dir), entity=["run_id", "chrom"], start="start_pos", end="end_pos", best="summit_height", keep=["summit"]).drop("summit")


def open_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases under peaks of each run, overlaps counted once."""
    spans = periods_and_gaps(peaks(spark, sf_dir), entity=["run_id", "chrom"]).filter(F.col("kind") == "period")
    return spans.groupBy("run_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_bases"))


def peak_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each run: count, bases, mean and median width, part below 500 bases, best score."""
    width = F.col("end_pos") - F.col("start_pos")
    return (
        peaks(spark, sf_dir)
        .withColumn("_w", width)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("n_peaks"),
            F.sum("_w").alias("n_bases"),
            F.round(F.avg("_w"), 5).alias("mean_width"),
            F.round(F.expr("percentile(_w, 0.5)"), 5).alias("median_width"),
            F.round(F.avg((F.col("_w") < 500).cast("double")), 6).alias("narrow"),
            F.max("summit_height").alias("best_height"),
        )
    )


def top_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred highest peaks."""
    return peaks(spark, sf_dir).filter(F.col("summit_height").isNotNull()).orderBy(F.desc("summit_height"), "peak_id").limit(100).select("peak_id", "run_id", "summit_height")


def summit_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summits per megabase, empty megabases included."""
    return O.filled_bins(peaks(spark, sf_dir).filter(F.col("summit") >= 0), entity="chrom", position="summit", width=1_000_000)


def covered_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks called from the coverage of calls, positions counted in thousands."""
    rows = _sites(spark, sf_dir).filter("pos >= 0").select("chrom", F.floor(F.col("pos") / 1000).alias("at"))
    lengths = rows.groupBy("chrom").agg((F.max("at") + 50).alias("length"))
    found = O.call_peaks(rows, lengths, start="at", is_reverse=F.lit(False), extend=1, least=4.0)
    return found.select("chrom", "start_pos", "end_pos", "summit", "height", F.round("score", 4).alias("score"), F.round("fold", 5).alias("fold"))


def call_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of chromosomes where called positions lie dense."""
    return O.dense_islands(_sites(spark, sf_dir), entity=["chrom"], position="pos", span=200, least=5)


def call_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a sample where its called positions crowd."""
    return O.clustered_sites(_sites(spark, sf_dir), entity=["sample_id", "chrom"], position="pos")


def frequency_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calls in a row of a sample with mostly high or mostly low frequencies."""
    af = F.col("af").cast("double")
    rows = calls(spark, sf_dir, "chrom", "pos", "af", "sample_id").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & ~F.isnan(af))
    return O.sliding_regions(rows, entity=["sample_id", "chrom"], order=["pos", "record_id"], value=af * 100)


def ratio_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the log ratio along each profile's chromosomes."""
    rows = segments(spark, sf_dir).filter(F.col("log2_ratio").isNotNull() & ~F.isnan("log2_ratio") & F.col("chrom").isNotNull() & F.col("profile_id").isNotNull())
    return O.change_points(rows, entity=["profile_id", "chrom"], order=["start_pos", "segment_id"], value="log2_ratio")


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each profile's chromosome of less than two megabases merged with their neighbours."""
    rows = segments(spark, sf_dir).filter(F.col("chrom").isNotNull() & F.col("profile_id").isNotNull()).select("profile_id", "chrom", "segment_id", "start_pos", "end_pos")
    sized = rows.groupBy("profile_id", "chrom", "start_pos", "end_pos").agg((F.max("end_pos") - F.max("start_pos")).alias("size"))
    found = O.merge_small(sized, entity=["profile_id", "chrom"], start="start_pos", end="end_pos", size="size", least=SMALL)
    return found.groupBy("profile_id", "chrom").agg(F.count("*").alias("n_segments"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum(F.col("start_pos") % 1009).alias("starts"))


def copy_number_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, altered part and length-weighted ploidy of each profile."""
    return C.summarize_segments(segments(spark, sf_dir), ["profile_id"])


def copy_number_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported class against the classes by copy number and by log ratio."""
    rows = segments(spark, sf_dir)
    return rows.groupBy("cn_class", C.copy_class(F.col("copy_number")).alias("by_number"), C.ratio_class(F.col("log2_ratio")).alias("by_ratio")).agg(F.count("*").alias("n_segments"))


def copy_number_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty strongest amplifications and the fifty deepest deletions with a gene."""
    return C.driver_segments(segments(spark, sf_dir), 50)


QUERIES = {
    f.__name__: f
    for f in (
        peaks_in_genes,
        first_gene_of_peak,
        calls_in_genes,
        calls_outside_genes,
        merged_peaks,
        open_bases,
        peak_run_summary,
        top_peaks,
        summit_density,
        covered_peaks,
        call_islands,
        call_clusters,
        frequency_regions,
        ratio_change_points,
        merged_segments,
        copy_number_by_profile,
        copy_number_classes,
        copy_number_drivers,
    )
}
_HITS = """hits AS (
  SELECT p.*, g.interval_id, g.gene_id, g.start_pos AS gene_start, g.end_pos AS gene_end FROM peaks p JOIN genes g ON p.chrom = g.chrom AND p.start_pos < g.end_pos AND g.start_pos < p.end_pos)"""


def _merged_sql(source: str, entity: str, out: str) -> str:
    """Overlapping and touching intervals of ``source`` as ``out``."""
    return f"""{out}_reach AS (
      SELECT *, max(end_pos) OVER (PARTITION BY {entity} ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT {entity}, start_pos, end_pos FROM {source})),
    {out}_numbered AS (
      SELECT *, sum(CASE WHEN before IS NULL OR start_pos > before THEN 1 ELSE 0 END) OVER (PARTITION BY {entity} ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS n FROM {out}_reach),
    {out} AS (SELECT {entity}, n, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM {out}_numbered GROUP BY {entity}, n)"""


_CN = """CASE WHEN copy_number < 0.5 THEN 'homdel' WHEN copy_number < 1.5 THEN 'hetdel' WHEN copy_number < 2.5 THEN 'diploid' WHEN copy_number < 4.5 THEN 'lowamp' WHEN copy_number IS NOT NULL THEN 'highamp' END"""
_SITES = "sites AS (SELECT DISTINCT sample_id, chrom, pos FROM calls WHERE sample_id IS NOT NULL AND chrom IS NOT NULL AND pos IS NOT NULL)"
_ERFC = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)"


def _merge_pass(n: int) -> str:
    """One pass of merging small segments: ``m{n}`` to ``m{n + 1}``."""
    w = "PARTITION BY profile_id, chrom ORDER BY s, f"
    return f"""a{n} AS (SELECT *, row_number() OVER ({w}) - 1 AS i, size < {SMALL} AS small FROM m{n}),
      b{n} AS (SELECT *, coalesce(max(CASE WHEN NOT small THEN i END) OVER ({w} ROWS UNBOUNDED PRECEDING), -1) AS big FROM a{n}),
      c{n} AS (SELECT *, small AND (i - big - 1) % 2 = 0 AS takes FROM b{n}),
      d{n} AS (SELECT *, NOT coalesce(lag(takes) OVER ({w}), false) AND (lead(i) OVER ({w}) IS NOT NULL OR NOT small OR i = 0) AS opens FROM c{n}),
      e{n} AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS g FROM d{n}),
      m{n + 1} AS (SELECT profile_id, chrom, min(s) AS s, max(f) AS f, sum(size) AS size FROM e{n} GROUP BY profile_id, chrom, g)"""


SQL = {
    "merged_segments": f"""WITH {SEGMENTS}, m0 AS (SELECT DISTINCT profile_id, chrom, start_pos AS s, end_pos AS f, end_pos - start_pos AS size FROM segments WHERE chrom IS NOT NULL AND profile_id IS NOT NULL),
      {", ".join(_merge_pass(n) for n in range(8))}
      SELECT profile_id, chrom, count(*) AS n_segments, CAST(min(size) AS BIGINT) AS least, CAST(max(size) AS BIGINT) AS most, CAST(sum(s % 1009) AS BIGINT) AS starts FROM m8 GROUP BY profile_id, chrom""",
    "covered_peaks": f"""WITH {CALLS}, t AS (SELECT chrom, CAST(floor(pos / 1000) AS BIGINT) AS a FROM calls WHERE chrom IS NOT NULL AND pos >= 0), l AS (SELECT chrom, max(a) + 50 AS length FROM t GROUP BY chrom),
      c AS (SELECT chrom, a // 100 AS k, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT (SELECT count(*) FROM t) / (SELECT sum(length) FROM l) * 200 AS rate),
      w AS (SELECT c.chrom, length, k - d AS w, sum(n) AS n FROM c JOIN l USING (chrom), (SELECT unnest([0, 1]) AS d) WHERE k - d >= 0 AND (k - d) * 100 + 200 <= length GROUP BY ALL),
      u AS (SELECT DISTINCT n, rate, (n - 0.5 - rate) / sqrt(rate) AS z FROM w, r), v AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM u),
      q AS (SELECT n, max(rate) AS rate, least(300.0, -log10(greatest(CASE WHEN n < 50 THEN sum(exp((n + i) * ln(rate) - rate - lgamma(n + i + 1))) ELSE max(CASE WHEN z >= 0 THEN 0.5 * {_ERFC} ELSE 1 - 0.5 * {_ERFC} END) END, 1e-300))) AS score
        FROM v, range(200) g(i) GROUP BY n),
      s AS (SELECT chrom, length, w, n, score, n / rate AS fold, w - row_number() OVER (PARTITION BY chrom ORDER BY w) AS g FROM w JOIN q USING (n) WHERE score > 4),
      p AS (SELECT chrom, min(w) * 100 AS start_pos, CASE WHEN max(w) + 1 > floor((max(length) - 200) / 100) THEN max(length) ELSE (max(w) + 1) * 100 + 200 END AS end_pos, arg_max(w, (n, -w)) * 100 AS summit, max(n) AS height, arg_max(score, (n, -w)) AS score, arg_max(fold, (n, -w)) AS fold FROM s GROUP BY chrom, g),
      m AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
      o AS (SELECT *, sum(CASE WHEN before IS NULL OR start_pos > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS grp FROM m)
      SELECT chrom, min(start_pos) AS start_pos, CAST(max(end_pos) AS BIGINT) AS end_pos, arg_max(summit, (height, -start_pos)) AS summit, CAST(max(height) AS BIGINT) AS height, round(arg_max(score, (height, -start_pos)), 4) AS score, round(arg_max(fold, (height, -start_pos)), 5) AS fold FROM o GROUP BY chrom, grp""",
    "peaks_in_genes": f"""WITH {PEAKS}, {GENES}, {_HITS},
      counted AS (SELECT interval_id, count(*) AS n, sum(least(end_pos, gene_end) - greatest(start_pos, gene_start)) AS b FROM hits GROUP BY interval_id)
      SELECT g.interval_id, g.gene_id, coalesce(n, 0) AS n_peaks, CAST(coalesce(b, 0) AS BIGINT) AS shared_bases FROM genes g LEFT JOIN counted c ON g.interval_id = c.interval_id""",
    "first_gene_of_peak": f"""WITH {PEAKS}, {GENES}, {_HITS}
      SELECT peak_id, arg_min(gene_id, (gene_start, gene_id)) AS gene_id, count(DISTINCT gene_id) AS n_genes FROM hits GROUP BY peak_id""",
    "calls_in_genes": f"""WITH {CALLS}, {GENES}
      SELECT gene_id, cohort, count(DISTINCT record_id) AS n_calls FROM (SELECT g.gene_id, c.cohort, c.record_id FROM calls c JOIN genes g ON c.chrom = g.chrom AND c.pos >= g.start_pos AND c.pos < g.end_pos) GROUP BY gene_id, cohort""",
    "calls_outside_genes": f"""WITH {CALLS}, {GENES}
      SELECT chrom, count(*) AS n_calls FROM calls c WHERE chrom IS NOT NULL AND pos IS NOT NULL AND record_id NOT IN (
        SELECT c.record_id FROM calls c JOIN genes g ON c.chrom = g.chrom AND c.pos >= g.start_pos AND c.pos < g.end_pos) GROUP BY chrom""",
    "merged_peaks": f"""WITH {PEAKS}, {_merged_sql("peaks", "run_id, chrom", "spans")}
      SELECT s.run_id, s.chrom, s.start_pos, s.end_pos, count(*) AS n_merged, max(summit_height) AS summit_height
      FROM spans s JOIN peaks p ON s.run_id = p.run_id AND s.chrom = p.chrom AND p.start_pos >= s.start_pos AND p.end_pos <= s.end_pos GROUP BY ALL""",
    "open_bases": f"""WITH {PEAKS}, {_merged_sql("peaks", "run_id, chrom", "spans")}
      SELECT run_id, count(*) AS n_spans, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_bases FROM spans GROUP BY run_id""",
    "peak_run_summary": f"""WITH {PEAKS}, wide AS (SELECT *, end_pos - start_pos AS w FROM peaks)
      SELECT run_id, count(*) AS n_peaks, CAST(sum(w) AS BIGINT) AS n_bases, round(avg(w), 5) AS mean_width, round(median(w), 5) AS median_width,
        round(avg(CASE WHEN w < 500 THEN 1.0 ELSE 0.0 END), 6) AS narrow, max(summit_height) AS best_height FROM wide GROUP BY run_id""",
    "top_peaks": f"WITH {PEAKS} SELECT peak_id, run_id, summit_height FROM peaks WHERE summit_height IS NOT NULL ORDER BY summit_height DESC, peak_id LIMIT 100",
    "summit_density": f"""WITH {PEAKS}, counted AS (SELECT chrom, summit // 1000000 AS bin, count(*) AS n FROM peaks WHERE summit >= 0 GROUP BY ALL),
      bins AS (SELECT chrom, unnest(range(0, max(bin) + 1)) AS bin FROM counted GROUP BY chrom)
      SELECT b.chrom, b.bin, coalesce(n, 0) AS n_rows FROM bins b LEFT JOIN counted c ON b.chrom = c.chrom AND b.bin = c.bin""",
    "call_islands": f"""WITH {CALLS}, sites AS (SELECT DISTINCT chrom, pos FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL),
      counted AS (SELECT chrom, pos, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 199 FOLLOWING) AS n FROM sites),
      seeds AS (SELECT chrom, pos AS start_pos, pos + 200 AS end_pos FROM counted WHERE n >= 5 AND n / 12.5 >= 0.6), {_merged_sql("seeds", "chrom", "spans")}
      SELECT chrom, start_pos, end_pos FROM spans WHERE end_pos - start_pos >= 200""",
    "call_clusters": f"""WITH {CALLS}, {_SITES},
      gaps AS (SELECT *, ln(pos - lag(pos) OVER (PARTITION BY sample_id, chrom ORDER BY pos) + 1.0) AS g FROM sites),
      framed AS (SELECT *, avg(g) OVER f AS m, count(g) OVER f AS n, last_value(pos) OVER f AS last_pos FROM gaps
        WINDOW f AS (PARTITION BY sample_id, chrom ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
      seeds AS (SELECT sample_id, chrom, pos AS start_pos, last_pos + 1 AS end_pos FROM framed WHERE n = 5 AND exp(m) < 1000), {_merged_sql("seeds", "sample_id, chrom", "spans")}
      SELECT sample_id, chrom, start_pos, end_pos FROM spans""",
    "frequency_regions": f"""WITH {CALLS}, framed AS (
      SELECT sample_id, chrom, pos, avg(CAST(af AS DOUBLE) * 100) OVER f AS m, count(*) OVER f AS n, last_value(pos) OVER f AS end_pos FROM calls
      WHERE chrom IS NOT NULL AND pos IS NOT NULL AND af IS NOT NULL AND NOT isnan(af) WINDOW f AS (PARTITION BY sample_id, chrom ORDER BY pos, record_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
      SELECT sample_id, chrom, pos AS start_pos, end_pos, CASE WHEN m > 80 THEN 'hyper' ELSE 'hypo' END AS kind, round(m, 5) AS mean FROM framed WHERE n = 5 AND (m > 80 OR m < 20)""",
    "ratio_change_points": f"""WITH {SEGMENTS}, smooth AS (
      SELECT *, avg(CAST(log2_ratio AS DOUBLE)) OVER (PARTITION BY profile_id, chrom ORDER BY start_pos, segment_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM segments
      WHERE log2_ratio IS NOT NULL AND NOT isnan(log2_ratio) AND chrom IS NOT NULL AND profile_id IS NOT NULL),
      jumps AS (SELECT *, CASE WHEN coalesce(abs(m - lag(m) OVER (PARTITION BY profile_id, chrom ORDER BY start_pos, segment_id)) > 0.3, true) THEN 1 ELSE 0 END AS j FROM smooth),
      numbered AS (SELECT *, sum(j) OVER (PARTITION BY profile_id, chrom ORDER BY start_pos, segment_id ROWS UNBOUNDED PRECEDING) AS segment_no FROM jumps)
      SELECT profile_id, chrom, CAST(segment_no AS BIGINT) AS segment_no, count(*) AS n_rows, min(start_pos) AS first_pos, max(start_pos) AS last_pos, round(avg(m), 5) AS level FROM numbered GROUP BY profile_id, chrom, segment_no""",
    "copy_number_by_profile": f"""WITH {SEGMENTS}, classed AS (SELECT *, end_pos - start_pos AS w, {_CN} AS kind FROM segments)
      SELECT profile_id, count(*) AS n_segments, count(*) FILTER (kind = 'homdel') AS n_homdel, count(*) FILTER (kind = 'hetdel') AS n_hetdel, count(*) FILTER (kind = 'diploid') AS n_diploid,
        count(*) FILTER (kind = 'lowamp') AS n_lowamp, count(*) FILTER (kind = 'highamp') AS n_highamp, CAST(sum(w) AS BIGINT) AS n_bases,
        round(coalesce(sum(CASE WHEN kind <> 'diploid' THEN w END), 0) / sum(w), 6) AS altered,
        round(coalesce(sum(CAST(copy_number AS DOUBLE) * w) / sum(CASE WHEN copy_number IS NOT NULL THEN w END), 2.0), 5) AS ploidy FROM classed GROUP BY profile_id""",
    "copy_number_classes": f"""WITH {SEGMENTS} SELECT cn_class, {_CN} AS by_number,
      CASE WHEN isnan(log2_ratio) OR log2_ratio IS NULL THEN NULL WHEN log2_ratio > 0.7 THEN 'highamp' WHEN log2_ratio > 0.3 THEN 'lowamp' WHEN log2_ratio < -0.3 THEN 'hetdel' ELSE 'diploid' END AS by_ratio,
      count(*) AS n_segments FROM segments GROUP BY ALL""",
    "copy_number_drivers": f"""WITH {SEGMENTS}, classed AS (SELECT *, {_CN} AS kind FROM segments WHERE gene <> ''),
      up AS (SELECT segment_id, gene, kind, copy_number FROM classed WHERE kind = 'highamp' ORDER BY copy_number DESC, segment_id LIMIT 50),
      down AS (SELECT segment_id, gene, kind, copy_number FROM classed WHERE kind = 'homdel' ORDER BY copy_number, segment_id LIMIT 50)
      SELECT segment_id, gene, kind, round(CAST(copy_number AS DOUBLE), 4) AS copy_number FROM (SELECT * FROM up UNION ALL SELECT * FROM down)""",
}
