"""Queries of small reports and of scores against catalogues that follow from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import copynumber, reads, scores, summaries, testing, variants
from strandline.operators.clusters import top_by
from strandline.operators.overlap import overlap_join
from strandline.plans import statistics_queries as S
from strandline.plans.interval_queries import _genes, _sites
from strandline.plans.model_queries import _ODDS, _OBSERVED, _observed
from strandline.plans.views import CALLS, EXPRESSION, GENES, PEAKS, SEGMENTS, calls, expression, genes, peaks, segments


def chromosome_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each chromosome: ratio, depth, altered part."""
    found = summaries.chromosome_copies(segments(spark, sf_dir), ["chrom"], ratio="log2_ratio", depth="copy_number")
    return found.select("chrom", "n_segments", F.round("mean_ratio", 5).alias("mean_ratio"), F.round("median_depth", 5).alias("median_depth"), F.round("altered", 6).alias("altered"))


def ratio_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by the class of their log ratio and that of their copy number."""
    return segments(spark, sf_dir).groupBy(copynumber.ratio_class(F.col("log2_ratio")).alias("by_ratio"), copynumber.copy_class(F.col("copy_number")).alias("by_copies")).agg(F.count("*").alias("n"))


def tumour_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumour sites by verdict, with frequency, transitions and transversions."""
    rows = _observed(spark, sf_dir)
    side = lambda panel: rows.filter(F.col("panel") == panel).groupBy("chrom", "pos").agg(F.count("*").alias("depth"), F.count(F.when(F.col("is_alt"), 1)).alias("n_alt"))
    sites = reads.contrast_sites(side("tumor"), side("germline"), on=["chrom", "pos"])
    alleles = calls(spark, sf_dir, "panel", "chrom", "pos", "ref_allele", "alt_allele").filter((F.col("panel") == "tumor") & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    found = summaries.site_report(sites, alleles, on=["chrom", "pos"])
    return found.select("verdict", "n_sites", F.round("frequency", 5).alias("frequency"), "n_ts", "n_tv", F.round("titv", 5).alias("titv"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks per bin of their score, with the median."""
    found = summaries.score_histogram(peaks(spark, sf_dir).filter(F.col("neg_log10_pvalue") < float("inf")), score="neg_log10_pvalue")
    return found.select(F.col("bin").cast("long").alias("bin"), "n", F.round("median", 5).alias("median"), "n_rows")


def gene_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls assigned to genes, and the part of all calls."""
    sites = _sites(spark, sf_dir)
    found = overlap_join(sites, _genes(spark, sf_dir), left_span=("pos", "pos_end"), right_span=("gene_start", "gene_end"))
    counts = found.groupBy("record_id").agg(F.min(F.struct("gene_start", "gene_id")).alias("_g")).groupBy(F.col("_g.gene_id").alias("gene_id")).agg(F.count("*").alias("n"))
    report = summaries.assignment_report(counts, sites.agg(F.count("*").alias("n")), gene="gene_id", n="n")
    return report.select("assigned", "detected", F.round("rate", 6).alias("rate"))


def significant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty surest peaks of each run, by adjusted p-value, then enrichment; whether each passes."""
    rows = peaks(spark, sf_dir).filter(F.col("neg_log10_pvalue") >= 0).withColumn("p", F.pow(F.lit(10.0), -F.col("neg_log10_pvalue") / 10)).withColumn("fold", F.when((F.col("fold_enrichment") < 1e6) & (F.col("fold_enrichment") >= 0), F.col("fold_enrichment")).otherwise(0.0))
    adjusted = testing.adjust_p_values(rows.select("run_id", "peak_id", "fold", "p"), p="p", family=["run_id"]).withColumn("padj", F.round("padj", 9))
    best = top_by(adjusted, ["run_id"], [F.asc_nulls_last("padj"), F.desc("fold"), "peak_id"], 20)
    return best.select("run_id", "peak_id", F.col("place").cast("long").alias("place"), summaries.significant(best, p="padj", effect="fold", most=0.5, least=3.0).alias("passes"))


def top_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten reference sets that the two hundred most called genes enrich most."""
    found = S.set_enrichment(spark, sf_dir)
    return found.orderBy("padj", "p", F.desc("overlap"), "set_key").limit(10).select("set_key", "overlap")


def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty features that vary most."""
    return S.variable_features(spark, sf_dir).orderBy(F.desc("score"), "feature").limit(20).select("feature", "score")


def passing_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that are no decoys and pass a q-value of five per cent, by run."""
    rows = peaks(spark, sf_dir).filter(F.col("neg_log10_pvalue") >= 0).withColumn("decoy", F.coalesce(F.col("summit_height") < 15, F.lit(True)))
    scored = testing.target_decoy(rows, score="neg_log10_pvalue", decoy=F.col("decoy"), key="peak_id")
    return scored.filter(~F.col("decoy") & (F.round("q_value", 9) <= 0.2)).groupBy("run_id").agg(F.count("*").alias("n_passing"))


def measure_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of three measures of the segments."""
    rows = segments(spark, sf_dir)
    measures = {"copies": F.col("copy_number").cast("double"), "ratio": F.col("log2_ratio").cast("double"), "length": F.log((F.col("end_pos") - F.col("start_pos")).cast("double"))}
    long = rows.select("segment_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in measures.items()])).alias("_x")).select("segment_id", "_x.*")
    return summaries.correlation_matrix(long, row=["segment_id"], name="name", value="value").select("a", "b", "n", F.round("r", 5).alias("r"))


def cohort_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case against control: calls, their ratio, transition ratios, genes of one side only, by panel."""
    rows = calls(spark, sf_dir, "cohort", "panel", "ref_allele", "alt_allele", "gene").filter(F.col("panel").isNotNull()).withColumn("_k", variants.variant_class(F.col("ref_allele"), F.col("alt_allele")))
    n = lambda c, k=None: F.count(F.when((F.col("cohort") == c) & (F.lit(True) if k is None else F.col("_k") == k), 1))
    counted = rows.groupBy("panel").agg(n("case").alias("n_case"), n("control").alias("n_control"), *[n(c, k).alias(f"_{c}_{k}") for c in ("case", "control") for k in ("Transition", "Transversion")])
    sides = rows.filter(F.col("gene") != "").groupBy("panel", "gene").agg(F.max((F.col("cohort") == "case").cast("int")).alias("a"), F.max((F.col("cohort") == "control").cast("int")).alias("b"))
    only = sides.groupBy("panel").agg(F.count(F.when((F.col("a") == 1) & (F.col("b") == 0), 1)).alias("n_gained"), F.count(F.when((F.col("a") == 0) & (F.col("b") == 1), 1)).alias("n_lost"))
    ratio = lambda c: F.round(F.try_divide(F.col(f"_{c}_Transition"), F.col(f"_{c}_Transversion")), 5)
    joined = counted.join(only, "panel", "left")
    return joined.select("panel", "n_case", "n_control", F.round(F.try_divide("n_case", "n_control"), 5).alias("burden"), ratio("case").alias("titv_case"), ratio("control").alias("titv_control"), F.coalesce("n_gained", F.lit(0)).alias("n_gained"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


def log_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and complements of the peaks' probabilities, in logarithms."""
    a, b = -F.col("neg_log10_pvalue"), -F.col("summit_height") / 7.0
    rows = peaks(spark, sf_dir).filter((F.col("neg_log10_pvalue") > 0) & F.col("summit_height").isNotNull())
    return rows.select("peak_id", F.round(summaries.log_sum_exp(a, b), 6).alias("two"), F.round(summaries.log_sum_exp(a, b, F.lit(-3.0)), 6).alias("three"), F.round(summaries.log_one_less_exp(b / 50), 6).alias("rest"))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples scored by a catalogue of the calls of high quality, panels in the place of diseases."""
    rows = calls(spark, sf_dir, "sample_id", "panel", "chrom", "pos", "alt_allele", "qual", "af").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    known = rows.filter((F.col("qual") >= 120) & ~F.isnan("qual") & F.col("panel").isNotNull() & F.col("alt_allele").rlike("^[ACGTacgt]+$"))
    odds = known.groupBy(F.col("panel").alias("disease"), "chrom", "pos", F.col("alt_allele").alias("risk_allele")).agg((1.0 + F.max(F.coalesce(F.nanvl(F.col("af").cast("double"), F.lit(0.5)), F.lit(0.5)))).alias("odds_ratio"))
    baselines = odds.select("disease").distinct().select("disease", F.lit(0.4).alias("mean"), F.lit(0.25).alias("spread"))
    found = scores.risk_scores(rows, odds, baselines, sample="sample_id")
    return found.select("sample_id", "disease", "n_matched", F.round("score", 5).alias("score"), F.round("z", 4).alias("z"))


def clock_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age by a clock whose sites are the gene starts, and called frequencies their values."""
    sites = calls(spark, sf_dir, "chrom", "pos", "af").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & (F.col("af") >= 0) & (F.col("af") <= 1)).select("chrom", "pos", F.round(F.col("af").cast("double") * 100, 6).alias("value"))
    clock = genes(spark, sf_dir).select("interval_id", "chrom", F.col("start_pos").alias("pos"), ((F.col("interval_id") % 7 - 3) / 10.0).alias("weight"))
    found = scores.clock_age(sites, clock, key="interval_id", intercept=0.3, least=1)
    return found.select("n_matched", F.round("age", 4).alias("age"))


def panel_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a panel of all genes by name, looked up by their ids as aliases."""
    means = expression(spark, sf_dir).groupBy(F.col("gene_id").alias("gene")).agg(F.avg("value").alias("value"))
    panel = genes(spark, sf_dir).filter(F.col("gene_name") != "").groupBy(F.col("gene_name").alias("gene")).agg(F.min("gene_id").alias("_id"), F.max(F.when(F.col("strand") == "+", 1.0).otherwise(0.5)).alias("weight"))
    found = scores.panel_score(means, panel.select("gene", "weight", F.array("_id").alias("aliases")))
    return found.select("n_found", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        chromosome_copies,
        ratio_classes,
        tumour_report,
        score_histogram,
        gene_assignment,
        significant_order,
        top_sets,
        top_features,
        passing_peaks,
        measure_correlations,
        cohort_contrast,
        log_sums,
        risk_scores,
        clock_age,
        panel_score,
    )
}
_KIND = """CASE WHEN length(r) <> length(b) THEN 'Indel' WHEN length(r) <> 1 THEN 'Other' WHEN r || b IN ('AG', 'GA', 'CT', 'TC') THEN 'Transition'
  WHEN r IN ('A', 'C', 'G', 'T') AND b IN ('A', 'C', 'G', 'T') THEN 'Transversion' WHEN r || b IS NOT NULL THEN 'Other' END"""
_FIRST = "CASE WHEN length(ref_allele) = 1 AND length(alt_allele) > 1 THEN string_split(upper(alt_allele), ',')[1] ELSE upper(alt_allele) END"
SQL = {
    "chromosome_copies": f"""WITH {SEGMENTS}, k AS (SELECT * FROM segments WHERE log2_ratio IS NOT NULL AND NOT isnan(log2_ratio))
      SELECT chrom, count(*) AS n_segments, round(avg(CAST(log2_ratio AS DOUBLE)), 5) AS mean_ratio, round(median(CAST(copy_number AS DOUBLE)), 5) AS median_depth, round(avg(CASE WHEN abs(CAST(log2_ratio AS DOUBLE)) > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS altered FROM k GROUP BY chrom""",
    "ratio_classes": f"""WITH {SEGMENTS} SELECT CASE WHEN log2_ratio IS NULL OR isnan(log2_ratio) THEN NULL WHEN log2_ratio > 0.7::FLOAT THEN 'highamp' WHEN log2_ratio > 0.3::FLOAT THEN 'lowamp' WHEN log2_ratio < -0.3::FLOAT THEN 'hetdel' ELSE 'diploid' END AS by_ratio,
      CASE WHEN copy_number IS NULL OR isnan(copy_number) THEN NULL WHEN copy_number < 0.5 THEN 'homdel' WHEN copy_number < 1.5 THEN 'hetdel' WHEN copy_number < 2.5 THEN 'diploid' WHEN copy_number < 4.5 THEN 'lowamp' ELSE 'highamp' END AS by_copies, count(*) AS n FROM segments GROUP BY ALL""",
    "tumour_report": f"""WITH {_OBSERVED}, s AS (SELECT panel, chrom, pos, count(*) AS d, count(*) FILTER (is_alt) AS a FROM observed GROUP BY ALL),
      b AS (SELECT t.chrom, t.pos, t.d AS t_depth, t.a AS t_alt, n.d AS n_depth, n.a AS n_alt, {_ODDS("t.d", "t.a")} AS lod FROM s t JOIN s n ON t.chrom = n.chrom AND t.pos = n.pos AND t.panel = 'tumor' AND n.panel = 'germline'),
      v AS (SELECT *, CASE WHEN lod < 6.3 THEN 'weak' WHEN n_alt / n_depth > 0.03 THEN 'in_normal' ELSE 'pass' END AS verdict FROM b),
      al AS (SELECT DISTINCT chrom, pos, ref_allele, alt_allele, upper(ref_allele) AS r, {_FIRST} AS b FROM calls WHERE panel = 'tumor' AND chrom IS NOT NULL AND pos IS NOT NULL),
      k AS (SELECT chrom, pos, count(*) FILTER (kind = 'Transition') AS ts, count(*) FILTER (kind = 'Transversion') AS tv FROM (SELECT chrom, pos, {_KIND} AS kind FROM al) GROUP BY ALL)
      SELECT verdict, count(*) AS n_sites, round(avg(t_alt / t_depth), 5) AS frequency, CAST(coalesce(sum(ts), 0) AS BIGINT) AS n_ts, CAST(coalesce(sum(tv), 0) AS BIGINT) AS n_tv, round(coalesce(sum(ts) / nullif(sum(tv), 0), 0), 5) AS titv
      FROM v LEFT JOIN k ON k.chrom = v.chrom AND k.pos = v.pos GROUP BY verdict""",
    "score_histogram": f"""WITH {PEAKS}, k AS (SELECT neg_log10_pvalue AS s FROM peaks WHERE neg_log10_pvalue IS NOT NULL AND NOT isnan(neg_log10_pvalue) AND neg_log10_pvalue < 'inf'::DOUBLE), e AS (SELECT max(s) AS top, median(s) AS median, count(*) AS n FROM k)
      SELECT CAST(least(19, floor(greatest(s, 0) / greatest(top / 20, 1.0))) AS BIGINT) AS bin, count(*) AS n, round(max(median), 5) AS median, max(e.n) AS n_rows FROM k, e GROUP BY 1""",
    "gene_assignment": f"""WITH {CALLS}, {GENES}, c AS (SELECT record_id, chrom, pos FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL),
      h AS (SELECT c.record_id, arg_min(gene_id, (start_pos, gene_id)) AS gene_id FROM c JOIN genes g ON g.chrom = c.chrom AND c.pos >= g.start_pos AND c.pos < g.end_pos GROUP BY c.record_id, c.chrom, c.pos)
      SELECT count(DISTINCT record_id) AS assigned, count(DISTINCT gene_id) AS detected, round(count(DISTINCT record_id) / (SELECT count(*) FROM c), 6) AS rate FROM h""",
    "significant_order": f"""WITH {PEAKS}, ps AS (SELECT run_id, peak_id, pow(10.0, -neg_log10_pvalue / 10) AS p, CASE WHEN fold_enrichment < 1e6 AND fold_enrichment >= 0 THEN fold_enrichment ELSE 0.0 END AS fold FROM peaks WHERE neg_log10_pvalue >= 0 AND NOT isnan(neg_log10_pvalue)),
      r AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS m, count(*) OVER (PARTITION BY run_id ORDER BY p) AS upto FROM ps),
      a AS (SELECT run_id, peak_id, fold, round(least(1.0, min(p * m / upto) OVER (PARTITION BY run_id ORDER BY p DESC)), 9) AS padj FROM r),
      o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY padj, fold DESC, peak_id) AS place FROM a) SELECT run_id, peak_id, place, padj < 0.5 AND fold >= 3 AS passes FROM o WHERE place <= 20""",
    "top_sets": f"SELECT set_key, overlap FROM ({S.SQL['set_enrichment']}) ORDER BY padj, p, overlap DESC, set_key LIMIT 10",
    "top_features": f"SELECT feature, score FROM ({S.SQL['variable_features']}) ORDER BY score DESC, feature LIMIT 20",
    "passing_peaks": f"""WITH {PEAKS}, d AS (SELECT peak_id, run_id, neg_log10_pvalue AS s, CASE WHEN coalesce(summit_height < 15, true) THEN 1 ELSE 0 END AS d FROM peaks WHERE neg_log10_pvalue >= 0),
      c AS (SELECT *, sum(d) OVER o AS dc, count(*) OVER o AS nc FROM d WINDOW o AS (ORDER BY s DESC, peak_id ROWS UNBOUNDED PRECEDING)),
      q AS (SELECT run_id, d, min(least(1.0, (dc + 1) / greatest(nc - dc, 1))) OVER (ORDER BY s, peak_id DESC ROWS UNBOUNDED PRECEDING) AS q FROM c)
      SELECT run_id, count(*) AS n_passing FROM q WHERE d = 0 AND round(q, 9) <= 0.2 GROUP BY run_id""",
    "measure_correlations": f"""WITH {SEGMENTS}, m AS (SELECT segment_id, CAST(copy_number AS DOUBLE) AS copies, CAST(log2_ratio AS DOUBLE) AS ratio, ln(end_pos - start_pos) AS length FROM segments),
      l AS (SELECT segment_id, name, v FROM (UNPIVOT m ON copies, ratio, length INTO NAME name VALUE v) WHERE v IS NOT NULL AND NOT isnan(v))
      SELECT x.name AS a, y.name AS b, count(*) AS n, round(corr(x.v, y.v), 5) AS r FROM l x JOIN l y ON x.segment_id = y.segment_id AND x.name <= y.name GROUP BY ALL""",
    "cohort_contrast": f"""WITH {CALLS}, k AS (SELECT panel, cohort, gene, {_KIND} AS kind FROM (SELECT *, upper(ref_allele) AS r, {_FIRST} AS b FROM calls) WHERE panel IS NOT NULL),
      c AS (SELECT panel, count(*) FILTER (cohort = 'case') AS n_case, count(*) FILTER (cohort = 'control') AS n_control, count(*) FILTER (cohort = 'case' AND kind = 'Transition') AS ats, count(*) FILTER (cohort = 'case' AND kind = 'Transversion') AS atv,
        count(*) FILTER (cohort = 'control' AND kind = 'Transition') AS bts, count(*) FILTER (cohort = 'control' AND kind = 'Transversion') AS btv FROM k GROUP BY panel),
      g AS (SELECT panel, gene, bool_or(cohort = 'case') AS a, bool_or(cohort = 'control') AS b FROM k WHERE gene <> '' GROUP BY ALL), o AS (SELECT panel, count(*) FILTER (a AND NOT b) AS n_gained, count(*) FILTER (b AND NOT a) AS n_lost FROM g GROUP BY panel)
      SELECT c.panel, n_case, n_control, round(n_case / nullif(n_control, 0), 5) AS burden, round(ats / nullif(atv, 0), 5) AS titv_case, round(bts / nullif(btv, 0), 5) AS titv_control, coalesce(n_gained, 0) AS n_gained, coalesce(n_lost, 0) AS n_lost FROM c LEFT JOIN o ON o.panel = c.panel""",
    "log_sums": f"""WITH {PEAKS}, v AS (SELECT peak_id, -neg_log10_pvalue AS a, -summit_height / 7.0 AS b FROM peaks WHERE neg_log10_pvalue > 0 AND summit_height IS NOT NULL), t AS (SELECT *, greatest(a, b) AS m, greatest(a, b, -3.0) AS n FROM v)
      SELECT peak_id, round(m + ln(exp(a - m) + exp(b - m)), 6) AS two, round(n + ln(exp(a - n) + exp(b - n) + exp(-3.0 - n)), 6) AS three, round(ln(1 - exp(b / 50)), 6) AS rest FROM t""",
    "risk_scores": f"""WITH {CALLS}, c AS (SELECT * FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL),
      o AS (SELECT panel AS disease, chrom, pos, alt_allele, 1.0 + max(CASE WHEN af IS NULL OR isnan(af) THEN 0.5 ELSE CAST(af AS DOUBLE) END) AS odds FROM c WHERE qual >= 120 AND NOT isnan(qual) AND panel IS NOT NULL AND regexp_matches(alt_allele, '^[ACGTacgt]+$') GROUP BY ALL),
      h AS (SELECT DISTINCT c.sample_id, o.disease, o.chrom, o.pos, upper(o.alt_allele) AS risk, ln(odds) AS w FROM c JOIN o ON o.chrom = c.chrom AND o.pos = c.pos AND list_contains(string_split(upper(c.alt_allele), ','), upper(o.alt_allele)) WHERE c.sample_id IS NOT NULL)
      SELECT sample_id, disease, count(*) AS n_matched, round(sum(w), 5) AS score, round((sum(w) - 0.4) / 0.25, 4) AS z FROM h GROUP BY ALL""",
    "clock_age": f"""WITH {CALLS}, {GENES}, s AS (SELECT chrom, pos, round(CAST(af AS DOUBLE) * 100, 6) AS v FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL AND af >= 0 AND af <= 1),
      m AS (SELECT interval_id, arg_min(v, (s.pos, v)) AS v FROM genes g JOIN s ON s.chrom = g.chrom AND s.pos BETWEEN g.start_pos - 1 AND g.start_pos + 1 GROUP BY interval_id),
      t AS (SELECT count(*) AS n, coalesce(sum((interval_id % 7 - 3) / 10.0 * v / 100), 0) + 0.3 AS x FROM m)
      SELECT n AS n_matched, round(CASE WHEN n >= 1 THEN greatest(0, least(120, CASE WHEN x < 0 THEN 21 * exp(x) - 1 ELSE 21 * x + 20 END)) END, 4) AS age FROM t""",
    "panel_score": f"""WITH {EXPRESSION}, {GENES}, m AS (SELECT gene_id AS gene, avg(value) AS v FROM expression GROUP BY gene_id),
      p AS (SELECT gene_name AS gene, min(gene_id) AS id, max(CASE WHEN strand = '+' THEN 1.0 ELSE 0.5 END) AS w FROM genes WHERE gene_name <> '' GROUP BY gene_name),
      f AS (SELECT p.gene, w, coalesce(a.v, b.v) AS v FROM p LEFT JOIN m a ON a.gene = p.gene LEFT JOIN m b ON b.gene = p.id WHERE coalesce(a.v, b.v) IS NOT NULL)
      SELECT count(*) AS n_found, round(sum(log2(v + 1) / log2(101) * w) / sum(w), 6) AS score FROM f""",
}
