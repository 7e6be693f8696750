"""Queries of count models and of what follows their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import glm, testing
from strandline.plans.statistics_queries import _ERFC, _halves
from strandline.plans.views import EXPRESSION, PEAKS, expression, peaks

_KEY = ["batch_id", "gene_id"]


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression as counts, odd samples treated, with a moment estimate of each gene's
    dispersion; genes with counts on both sides."""
    rows = expression(spark, sf_dir).select(*_KEY, "sample_no", F.round(F.col("value") * 10).alias("count"), (F.col("sample_no") % 2).cast("double").alias("treated"))
    side = lambda f, b: f(F.when(F.col("treated") == b, F.col("count")))
    moments = rows.groupBy(*_KEY).agg(side(F.avg, 0).alias("_m0"), side(F.avg, 1).alias("_m1"), F.avg("count").alias("_m"), F.coalesce(F.var_samp("count"), F.lit(0.0)).alias("_v"))
    alpha = F.greatest((F.col("_v") - F.col("_m")) / (F.col("_m") * F.col("_m")), F.lit(0.01))
    kept = moments.filter((F.col("_m0") > 0) & (F.col("_m1") > 0)).select(*_KEY, alpha.alias("alpha"))
    return rows.join(kept, _KEY).withColumn("size", F.lit(1.0)).withColumn("full", glm.design(F.col("treated"))).withColumn("reduced", F.array(F.lit(1.0)))


def expression_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treated against untreated samples by a count model: effect, error, statistic."""
    found = glm.wald_tests(_counts(spark, sf_dir), gene=_KEY, value="count", size="size", dispersion="alpha", design="full", contrast=[0.0, 1.0])
    return found.select(*_KEY, F.round("log2fc", 4).alias("log2fc"), F.round("se", 4).alias("se"), F.round("wald", 3).alias("wald"), F.round("p", 4).alias("p"))


def expression_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the likelihoods of the models with and without the treatment."""
    found = glm.likelihood_ratio_tests(_counts(spark, sf_dir), gene=_KEY, value="count", size="size", dispersion="alpha", full="full", reduced="reduced", freedom=1)
    return found.select(*_KEY, F.round("stat", 3).alias("stat"), F.round("p", 4).alias("p"))


def outlying_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with a sample that pulls the model its way."""
    rows = _counts(spark, sf_dir)
    side = lambda b: F.avg(F.when(F.col("treated") == b, F.col("count")))
    effects = rows.groupBy(*_KEY).agg(F.log2(side(1) / side(0)).alias("log2fc"))
    found = glm.outlying_genes(rows, effects, gene=_KEY, value="count", size="size", dispersion="alpha", treated="treated", effect="log2fc")
    return found.select(*_KEY, F.round("cooks", 4).alias("cooks"), "outlier")


def filtered_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks' p-values adjusted over all runs, after a filter on their height."""
    rows = peaks(spark, sf_dir).filter((F.col("neg_log10_pvalue") >= 0) & F.col("summit_height").isNotNull()).select("peak_id", "summit_height", F.pow(F.lit(10.0), -F.col("neg_log10_pvalue") / 10).alias("p"))
    found = glm.filtered_by_mean(rows, key="peak_id", mean="summit_height", p="p")
    return found.select("peak_id", "filtered", F.round("padj", 6).alias("padj"))


def shrunken_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of halves of samples, shrunk by their errors."""
    tests = _halves(spark, sf_dir).filter(F.col("t") != 0).select(*_KEY, "difference", (F.col("difference") / F.col("t")).alias("se"))
    return glm.shrunken_effects(tests, effect="difference", se="se").select(*_KEY, F.round("shrunk", 5).alias("shrunk"))


def normalised_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median dispersion of each batch's genes after dividing samples by their size factors."""
    rows = expression(spark, sf_dir)
    factors = testing.size_factors(rows, gene=_KEY, sample=["batch_id", "sample_no"], value="value")
    scaled = rows.join(factors, ["batch_id", "sample_no"]).withColumn("x", F.col("value") / F.col("size_factor"))
    moments = scaled.groupBy(*_KEY).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")).filter((F.col("n") > 1) & (F.col("m") > 0))
    spread = F.greatest((F.col("v") - F.col("m")) / (F.col("m") * F.col("m")), F.lit(1e-8))
    return moments.withColumn("d", spread).groupBy("batch_id").agg(F.count("*").alias("n_genes"), F.round(F.expr("percentile(d, 0.5)"), 5).alias("dispersion"))


QUERIES = {f.__name__: f for f in (expression_wald, expression_likelihood, outlying_expression, filtered_peaks, shrunken_contrast, normalised_dispersion)}
_COUNTS = f"""{EXPRESSION}, c AS (SELECT batch_id, gene_id, round(value * 10) AS y, sample_no % 2 AS x FROM expression),
  m AS (SELECT batch_id, gene_id, avg(y) FILTER (x = 0) AS m0, avg(y) FILTER (x = 1) AS m1, avg(y) AS m, coalesce(var_samp(y), 0.0) AS v, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1 FROM c GROUP BY ALL),
  g AS (SELECT *, greatest((v - m) / (m * m), 0.01) AS a FROM m WHERE m0 > 0 AND m1 > 0)"""
SQL = {
    "expression_wald": f"""WITH {_COUNTS}, w AS (SELECT batch_id, gene_id, ln(m1 / m0) AS b, sqrt((1 + a * m0) / (n0 * m0) + (1 + a * m1) / (n1 * m1)) AS s FROM g),
      z AS (SELECT *, abs(b / s) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(b / s) / sqrt(2.0)) AS t FROM w)
      SELECT batch_id, gene_id, round(b / ln(2), 4) AS log2fc, round(s / ln(2), 4) AS se, round(b / s, 3) AS wald, round({_ERFC}, 4) AS p FROM z""",
    "expression_likelihood": f"""WITH {_COUNTS}, l AS (SELECT batch_id, gene_id, 2 * ((n0 / a + n0 * m0) * ln((1 / a + m) / (1 / a + m0)) + n0 * m0 * ln(m0 / m) + (n1 / a + n1 * m1) * ln((1 / a + m) / (1 / a + m1)) + n1 * m1 * ln(m1 / m)) AS q FROM g),
      s AS (SELECT *, greatest(q, 0) AS stat FROM l), z AS (SELECT *, sqrt(stat / 2) AS x, 1.0 / (1.0 + 0.3275911 * sqrt(stat / 2)) AS t FROM s)
      SELECT batch_id, gene_id, round(stat, 3) AS stat, round(CASE WHEN stat > 0 THEN {_ERFC} ELSE 1 END, 4) AS p FROM z""",
    "outlying_expression": f"""WITH {_COUNTS}, w AS (SELECT *, n0 / (1 / m0 + a) AS w0, n1 / (1 / m1 + a) AS w1 FROM g),
      r AS (SELECT c.batch_id, c.gene_id, y, CASE WHEN x = 0 THEN m0 ELSE m1 END AS mu, least(0.9999, CASE WHEN x = 0 THEN 1 / (1 / m0 + a) / w0 ELSE 1 / (1 / m1 + a) * (w0 + w1) / (w0 * w1) END) AS h FROM c JOIN w ON c.batch_id = w.batch_id AND c.gene_id = w.gene_id),
      k AS (SELECT batch_id, gene_id, max(pow(y - mu, 2) * h / (2 * mu * mu * pow(1 - h, 2))) AS cooks FROM r GROUP BY ALL)
      SELECT batch_id, gene_id, round(cooks, 4) AS cooks, cooks > 5 AS outlier FROM k""",
    "filtered_peaks": f"""WITH {PEAKS}, t AS (SELECT peak_id, CAST(summit_height AS DOUBLE) AS h, pow(10.0, -neg_log10_pvalue / 10) AS p FROM peaks WHERE neg_log10_pvalue >= 0 AND NOT isnan(neg_log10_pvalue) AND summit_height IS NOT NULL),
      o AS (SELECT list_sort(list(h)) AS hs, count(*) AS n FROM t), b AS (SELECT k, hs[least(CAST(floor(n * k * 0.05 + 1e-9) AS BIGINT), n - 1) + 1] AS bound FROM o, range(17) r(k)),
      e AS (SELECT k, bound, peak_id, p FROM b JOIN t ON h > bound), q AS (SELECT *, p * count(*) OVER (PARTITION BY k) / rank() OVER (PARTITION BY k ORDER BY p) AS raw, count(*) OVER (PARTITION BY k ORDER BY p) AS upto FROM e),
      a AS (SELECT k, bound, least(1.0, min(p * m / upto) OVER (PARTITION BY k ORDER BY p DESC)) AS padj FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM q)),
      s AS (SELECT b.k, b.bound, count(*) FILTER (padj < 0.1) AS passing FROM b LEFT JOIN a ON a.k = b.k GROUP BY b.k, b.bound), best AS (SELECT arg_max(bound, (passing, k)) AS bound FROM s),
      f AS (SELECT peak_id, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS upto FROM t, best WHERE h > bound), z AS (SELECT peak_id, least(1.0, min(p * m / upto) OVER (ORDER BY p DESC)) AS padj FROM f)
      SELECT t.peak_id, z.padj IS NULL AS filtered, round(coalesce(z.padj, 1.0), 6) AS padj FROM t LEFT JOIN z USING (peak_id)""",
    "shrunken_contrast": f"""WITH {EXPRESSION}, widths AS (SELECT *, max(sample_no) OVER (PARTITION BY batch_id, gene_id) AS w, log2(value + 0.5) AS v FROM expression),
      s AS (SELECT batch_id, gene_id, count(*) FILTER (sample_no <= ceil(w / 2)) AS n0, count(*) FILTER (sample_no > ceil(w / 2)) AS n1, avg(v) FILTER (sample_no <= ceil(w / 2)) AS m0, avg(v) FILTER (sample_no > ceil(w / 2)) AS m1,
        var_samp(v) FILTER (sample_no <= ceil(w / 2)) AS s0, var_samp(v) FILTER (sample_no > ceil(w / 2)) AS s1 FROM widths GROUP BY batch_id, gene_id),
      d AS (SELECT batch_id, gene_id, m1 - m0 AS d, s0 / n0 + s1 / n1 AS q FROM s WHERE n0 >= 2 AND n1 >= 2 AND s0 / n0 + s1 / n1 >= 1e-30 AND m1 <> m0), p AS (SELECT median(d * d) AS prior FROM d)
      SELECT batch_id, gene_id, round(d * q / (q + prior), 5) AS shrunk FROM d, p""",
    "normalised_dispersion": f"""WITH {EXPRESSION}, refs AS (SELECT batch_id, gene_id, avg(ln(value)) AS ref FROM expression WHERE value > 0 GROUP BY batch_id, gene_id),
      f AS (SELECT e.batch_id, sample_no, median(exp(ln(value) - ref)) AS sf FROM expression e JOIN refs r ON e.batch_id = r.batch_id AND e.gene_id = r.gene_id WHERE value > 0 GROUP BY e.batch_id, sample_no),
      x AS (SELECT e.batch_id, gene_id, value / sf AS x FROM expression e JOIN f ON e.batch_id = f.batch_id AND e.sample_no = f.sample_no),
      m AS (SELECT batch_id, gene_id, avg(x) AS m, var_samp(x) AS v FROM x GROUP BY ALL HAVING count(*) > 1 AND avg(x) > 0)
      SELECT batch_id, count(*) AS n_genes, round(median(greatest((v - m) / (m * m), 1e-8)), 5) AS dispersion FROM m GROUP BY batch_id""",
}
