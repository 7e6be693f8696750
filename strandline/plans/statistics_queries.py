"""Queries of the statistical operators and of the count matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import cells as C
from strandline.operators import testing as T
from strandline.plans.views import CALLS, EXPRESSION, PEAKS, SEGMENTS, calls, expression, peaks, segments
from strandline.tables import table


def gene_expression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over samples, spread and highest value of each gene."""
    rows = expression(spark, sf_dir)
    per = rows.groupBy("gene_id").agg(F.count("*").alias("n_values"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("spread"), F.max("value").alias("highest"))
    return per.withColumn("expressed", F.col("mean") >= 1)


def top_expressed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred genes with the highest means."""
    return gene_expression_summary(spark, sf_dir).orderBy(F.desc("mean"), "gene_id").limit(100).select("gene_id", "mean")


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln values of each gene and batch, first against second half of the samples."""
    rows = expression(spark, sf_dir)
    widths = rows.groupBy("batch_id", "gene_id").agg(F.max("sample_no").alias("_width"))
    split = rows.join(widths, ["batch_id", "gene_id"])
    return T.welch(split, by=["batch_id", "gene_id"], second=F.col("sample_no") > F.ceil(F.col("_width") / 2), value=F.log2(F.col("value") + 0.5))


def expression_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's t of the halves of each gene's samples."""
    return _halves(spark, sf_dir).select(
        "batch_id", "gene_id", "n_first", "n_second", F.round("difference", 5).alias("difference"), F.round("t", 4).alias("t"), F.round("df", 4).alias("df")
    )


def expression_contrast_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p-values, adjusted within each batch."""
    tested = _halves(spark, sf_dir).withColumn("p", stats.t_two_sided("t", "df"))
    adjusted = T.adjust_p_values(tested.select("batch_id", "gene_id", "difference", "p"), p="p", family=["batch_id"])
    return adjusted.select("batch_id", "gene_id", F.round("difference", 5).alias("difference"), F.round("p", 6).alias("p"), F.round("padj", 6).alias("padj"))


def sample_size_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median-of-ratios factors of the samples of each batch."""
    factors = T.size_factors(expression(spark, sf_dir), gene=["batch_id", "gene_id"], sample=["batch_id", "sample_no"], value="value")
    return factors.select("batch_id", F.col("sample_no").cast("long").alias("sample_no"), F.round("size_factor", 5).alias("size_factor"))


def adjusted_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks' p-values adjusted within each run: how many stay below 5 per cent."""
    rows = peaks(spark, sf_dir).filter(F.col("neg_log10_pvalue") >= 0).withColumn("p", F.pow(F.lit(10.0), -F.col("neg_log10_pvalue")))
    adjusted = T.adjust_p_values(rows.select("run_id", "peak_id", "p"), p="p", family=["run_id"])
    return adjusted.groupBy("run_id").agg(F.count("*").alias("n_peaks"), F.count(F.when(F.col("padj") < 0.05, 1)).alias("n_significant"), F.round(F.sum("padj"), 5).alias("total"))


def peak_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target-decoy q-values of all peaks, those with a low summit counted as decoys."""
    rows = peaks(spark, sf_dir).filter(F.col("neg_log10_pvalue") >= 0)
    scored = T.target_decoy(rows, score="neg_log10_pvalue", decoy=F.coalesce(F.col("summit_height") < 15, F.lit(True)), key="peak_id")
    return scored.select("peak_id", F.round("q_value", 6).alias("q_value"))


def copy_ratio_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of copy number and log ratio within each profile."""
    return T.spearman(segments(spark, sf_dir), by=["profile_id"], x="copy_number", y="log2_ratio").select("profile_id", "n", F.round("rho", 5).alias("rho"))


def narrow_peak_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summit heights of narrow against wide peaks in each run, by ranks."""
    scored = T.rank_sum(peaks(spark, sf_dir), by=["run_id"], group=F.col("end_pos") - F.col("start_pos") < 500, value="summit_height")
    return scored.select("run_id", "n", "n_in", F.round("u", 3).alias("u"), F.round("auc", 6).alias("auc"), F.round("z", 5).alias("z"), F.round("p", 6).alias("p"))


def _set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ref_gene_sets").select("set_key", F.explode("genes").alias("g"))
    return rows.select("set_key", F.upper(F.trim("g")).alias("gene")).filter(F.col("gene") != "").distinct()


def _called_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir, "gene").filter(F.col("gene") != "").groupBy(F.upper("gene").alias("gene")).agg(F.count("*").alias("n"))


def _ranked_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All called genes with their rank, the most called first."""
    return T.ranked_all(_called_genes(spark, sf_dir), score="n", key="gene")


def set_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sets rich in the two hundred most called genes."""
    query = _called_genes(spark, sf_dir).orderBy(F.desc("n"), "gene").limit(200)
    found = T.over_representation(query, _set_members(spark, sf_dir), set_key="set_key")
    return found.select("set_key", "overlap", "set_size", F.round("p", 7).alias("p"), F.round("padj", 6).alias("padj"))


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment score of each reference set along all called genes."""
    scored = T.enrichment_scores(_ranked_genes(spark, sf_dir), _set_members(spark, sf_dir), set_key="set_key")
    return scored.select("set_key", "n_hits", F.round("es", 5).alias("es"))


def set_even_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores with even steps, between minus one and one."""
    scored = T.enrichment_scores(_ranked_genes(spark, sf_dir), _set_members(spark, sf_dir), set_key="set_key", even=True)
    return scored.select("set_key", "n_hits", F.round("es", 6).alias("es"))


def set_leading_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading genes of each reference set."""
    return T.leading_genes(_ranked_genes(spark, sf_dir), _set_members(spark, sf_dir), set_key="set_key").select("set_key", "gene", F.col("rank").cast("long").alias("rank"))


def tail_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error function, chi-square and Poisson tails over the peaks' heights."""
    rows = peaks(spark, sf_dir)
    x = F.col("summit_height").cast("double")
    return rows.select(
        "peak_id",
        F.round(stats.normal_two_sided(x / 20), 6).alias("normal_p"),
        F.round(stats.chi_square_tail(x / 10, 1), 6).alias("chi_p1"),
        F.round(stats.chi_square_tail(x / 10, 2), 6).alias("chi_p2"),
        F.round(stats.poisson_log10_tail(F.col("summit_height"), F.lit(20.0)), 5).alias("poisson"),
    )


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cells, event types with their k div 10 as features."""
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 10)
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.concat_ws("-", "event_type", k.cast("string")).alias("feature"))
    return rows.groupBy("user_id", "event_type", "feature").agg(F.count("*").alias("n"))


def cell_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each cell; errors take the place of mitochondrial counts."""
    return C.cell_quality(_counts(spark, sf_dir), cell="user_id", feature="feature", n="n", marked=F.col("event_type") == "error")


def variable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersion scores of log-normalised features."""
    values = C.log_normalised(_counts(spark, sf_dir), cell="user_id", n="n")
    found = C.variable_features(values, feature="feature", cell="user_id", value="value")
    return found.select("feature", F.round("mean", 5).alias("mean"), F.round("variance", 5).alias("variance"), F.round("score", 4).alias("score"))


def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred log ratios by parity-free clusters: the cells' most frequent event type."""
    rows = _counts(spark, sf_dir)
    most = rows.groupBy("user_id", "event_type").agg(F.sum("n").alias("m")).groupBy("user_id").agg(F.max(F.struct("m", "event_type")).alias("x")).select("user_id", F.col("x.event_type").alias("cluster"))
    values = C.centred_log_ratio(rows.select("user_id", "feature", "n"), cell="user_id", n="n")
    found = C.cluster_profiles(values.join(most, "user_id"), cluster="cluster", cell="user_id", feature="feature", value="value")
    return found.select("cluster", "feature", F.round("mean", 5).alias("mean"), F.round("part", 6).alias("part"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth, against all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = C.nearest_neighbours(rows.filter(F.col("vec_id") % 50 == 0), rows, key="vec_id", vector="embedding", k=10)
    return found.select("vec_id", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("distance", 4).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (
        gene_expression_summary,
        top_expressed_genes,
        expression_contrast,
        expression_contrast_p,
        sample_size_factors,
        adjusted_peaks,
        peak_q_values,
        copy_ratio_correlation,
        narrow_peak_markers,
        set_enrichment,
        set_scores,
        set_even_scores,
        set_leading_genes,
        tail_functions,
        cell_quality,
        variable_features,
        cluster_profiles,
        nearest_vectors,
    )
}
_MEANS = """means AS (
  SELECT gene_id, count(*) AS n_values, round(avg(value), 9) AS mean, round(stddev_pop(value), 5) AS spread, max(value) AS highest FROM expression GROUP BY gene_id)"""
_RANKED = f"""{CALLS}, counted AS (SELECT upper(gene) AS gene, count(*) AS n FROM calls WHERE gene <> '' GROUP BY upper(gene)),
  ranked AS (SELECT gene, row_number() OVER (ORDER BY n DESC, gene) AS rank FROM counted),
  members AS (SELECT DISTINCT set_key, upper(trim(g)) AS gene FROM (SELECT set_key, unnest(genes) AS g FROM ref_gene_sets) WHERE trim(g) <> '')"""
_COUNTS = """counts AS (
  SELECT user_id, event_type, concat_ws('-', event_type, CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS VARCHAR)) AS feature, count(*) AS n FROM events GROUP BY ALL)"""
_ERFC = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)"
SQL = {
    "gene_expression_summary": f"WITH {EXPRESSION}, {_MEANS} SELECT *, mean >= 1 AS expressed FROM means",
    "top_expressed_genes": f"WITH {EXPRESSION}, {_MEANS} SELECT gene_id, mean FROM means ORDER BY mean DESC, gene_id LIMIT 100",
    "expression_contrast": f"""WITH {EXPRESSION}, widths AS (SELECT *, max(sample_no) OVER (PARTITION BY batch_id, gene_id) AS w, log2(value + 0.5) AS v FROM expression),
      s AS (SELECT batch_id, gene_id, count(*) FILTER (sample_no <= ceil(w / 2)) AS n0, count(*) FILTER (sample_no > ceil(w / 2)) AS n1,
        avg(v) FILTER (sample_no <= ceil(w / 2)) AS m0, avg(v) FILTER (sample_no > ceil(w / 2)) AS m1,
        var_samp(v) FILTER (sample_no <= ceil(w / 2)) AS s0, var_samp(v) FILTER (sample_no > ceil(w / 2)) AS s1 FROM widths GROUP BY batch_id, gene_id)
      SELECT batch_id, gene_id, n0 AS n_first, n1 AS n_second, round(m1 - m0, 5) AS difference,
        round(CASE WHEN n0 >= 2 AND n1 >= 2 AND s0 / n0 + s1 / n1 >= 1e-30 THEN (m1 - m0) / sqrt(s0 / n0 + s1 / n1) END, 4) AS t,
        round(CASE WHEN n0 >= 2 AND n1 >= 2 AND s0 / n0 + s1 / n1 >= 1e-30 THEN pow(s0 / n0 + s1 / n1, 2) / (pow(s0 / n0, 2) / (n0 - 1) + pow(s1 / n1, 2) / (n1 - 1)) END, 4) AS df FROM s""",
    "expression_contrast_p": f"""WITH {EXPRESSION}, widths AS (SELECT *, max(sample_no) OVER (PARTITION BY batch_id, gene_id) AS w, log2(value + 0.5) AS v FROM expression),
      s AS (SELECT batch_id, gene_id, count(*) FILTER (sample_no <= ceil(w / 2)) AS n0, count(*) FILTER (sample_no > ceil(w / 2)) AS n1,
        avg(v) FILTER (sample_no <= ceil(w / 2)) AS m0, avg(v) FILTER (sample_no > ceil(w / 2)) AS m1,
        var_samp(v) FILTER (sample_no <= ceil(w / 2)) AS s0, var_samp(v) FILTER (sample_no > ceil(w / 2)) AS s1 FROM widths GROUP BY batch_id, gene_id),
      t AS (SELECT batch_id, gene_id, m1 - m0 AS difference, CASE WHEN n0 >= 2 AND n1 >= 2 AND s0 / n0 + s1 / n1 >= 1e-30 THEN abs(m1 - m0) / sqrt(s0 / n0 + s1 / n1) END AS t,
        pow(s0 / n0 + s1 / n1, 2) / (pow(s0 / n0, 2) / (n0 - 1) + pow(s1 / n1, 2) / (n1 - 1)) AS df FROM s),
      -- Student's density over an angle: Simpson's rule on 1000 steps.
      a AS (SELECT batch_id, gene_id, sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(t / sqrt(df)) * i / 1000), df - 1)) * any_value(atan(t / sqrt(df))) / 3000
        * any_value(2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi())) AS inside FROM t, range(1001) r(i) WHERE t IS NOT NULL GROUP BY batch_id, gene_id),
      p AS (SELECT t.batch_id, t.gene_id, difference, 1 - inside AS p FROM t LEFT JOIN a ON a.batch_id = t.batch_id AND a.gene_id = t.gene_id),
      r AS (SELECT batch_id, gene_id, p, count(*) OVER (PARTITION BY batch_id) AS m, count(*) OVER (PARTITION BY batch_id ORDER BY p) AS upto FROM p WHERE p IS NOT NULL),
      j AS (SELECT batch_id, gene_id, least(1.0, min(p * m / upto) OVER (PARTITION BY batch_id ORDER BY p DESC)) AS padj FROM r)
      SELECT p.batch_id, p.gene_id, round(difference, 5) AS difference, round(p, 6) AS p, round(padj, 6) AS padj FROM p LEFT JOIN j ON j.batch_id = p.batch_id AND j.gene_id = p.gene_id""",
    "sample_size_factors": f"""WITH {EXPRESSION}, refs AS (SELECT batch_id, gene_id, avg(ln(value)) AS ref FROM expression WHERE value > 0 GROUP BY batch_id, gene_id)
      SELECT e.batch_id, CAST(sample_no AS BIGINT) AS sample_no, round(median(exp(ln(value) - ref)), 5) AS size_factor FROM expression e JOIN refs r ON e.batch_id = r.batch_id AND e.gene_id = r.gene_id
      WHERE value > 0 GROUP BY e.batch_id, sample_no""",
    "adjusted_peaks": f"""WITH {PEAKS}, ps AS (SELECT run_id, peak_id, pow(10.0, -neg_log10_pvalue) AS p FROM peaks WHERE neg_log10_pvalue >= 0 AND NOT isnan(neg_log10_pvalue)),
      r AS (SELECT *, p * count(*) OVER (PARTITION BY run_id) / row_number() OVER (PARTITION BY run_id ORDER BY p, peak_id) AS q FROM ps),
      a AS (SELECT run_id, least(1.0, min(q) OVER (PARTITION BY run_id ORDER BY p DESC, peak_id DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM r)
      SELECT run_id, count(*) AS n_peaks, count(*) FILTER (padj < 0.05) AS n_significant, round(sum(padj), 5) AS total FROM a GROUP BY run_id""",
    "peak_q_values": f"""WITH {PEAKS}, d AS (SELECT peak_id, neg_log10_pvalue AS s, CASE WHEN coalesce(summit_height < 15, true) THEN 1 ELSE 0 END AS d FROM peaks WHERE neg_log10_pvalue >= 0),
      c AS (SELECT *, sum(d) OVER o AS dc, count(*) OVER o AS nc FROM d WINDOW o AS (ORDER BY s DESC, peak_id ROWS UNBOUNDED PRECEDING)),
      f AS (SELECT *, least(1.0, (dc + 1) / greatest(nc - dc, 1)) AS fdr FROM c)
      SELECT peak_id, round(min(fdr) OVER (ORDER BY s, peak_id DESC ROWS UNBOUNDED PRECEDING), 6) AS q_value FROM f""",
    "copy_ratio_correlation": f"""WITH {SEGMENTS}, k AS (SELECT * FROM segments WHERE copy_number IS NOT NULL AND log2_ratio IS NOT NULL AND NOT isnan(copy_number) AND NOT isnan(log2_ratio)),
      r AS (SELECT profile_id, rank() OVER (PARTITION BY profile_id ORDER BY copy_number) + (count(*) OVER (PARTITION BY profile_id, copy_number) - 1) / 2.0 AS x,
        rank() OVER (PARTITION BY profile_id ORDER BY log2_ratio) + (count(*) OVER (PARTITION BY profile_id, log2_ratio) - 1) / 2.0 AS y FROM k)
      SELECT profile_id, count(*) AS n, round(CASE WHEN count(*) < 2 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 5) AS rho FROM r GROUP BY profile_id""",
    "narrow_peak_markers": f"""WITH {PEAKS}, r AS (SELECT run_id, CASE WHEN end_pos - start_pos < 500 THEN 1 ELSE 0 END AS g,
        rank() OVER (PARTITION BY run_id ORDER BY summit_height) + (count(*) OVER (PARTITION BY run_id, summit_height) - 1) / 2.0 AS r FROM peaks WHERE summit_height IS NOT NULL),
      s AS (SELECT run_id, count(*) AS n, sum(g) AS n_in, sum(r) FILTER (g = 1) AS w FROM r GROUP BY run_id HAVING sum(g) BETWEEN 1 AND count(*) - 1),
      u AS (SELECT *, w - n_in * (n_in + 1) / 2 AS u, n_in * (n - n_in) AS nn FROM s),
      z AS (SELECT *, (u - nn / 2) / sqrt(nn * (n + 1) / 12.0) AS z FROM u),
      e AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z)
      SELECT run_id, n, CAST(n_in AS BIGINT) AS n_in, round(u, 3) AS u, round(u / nn, 6) AS auc, round(z, 5) AS z, round(CASE WHEN n <= 20 THEN 1.0 ELSE {_ERFC} END, 6) AS p FROM e""",
    "set_enrichment": f"""WITH {_RANKED}, q AS (SELECT gene FROM ranked WHERE rank <= 200),
      c AS (SELECT (SELECT count(DISTINCT gene) FROM members) AS total, (SELECT count(*) FROM q) AS drawn),
      h AS (SELECT m.set_key, count(*) AS overlap FROM members m JOIN q ON m.gene = q.gene GROUP BY m.set_key),
      z AS (SELECT set_key, count(*) AS set_size FROM members GROUP BY set_key),
      terms AS (SELECT h.set_key, overlap, set_size, total, drawn, unnest(range(overlap, least(set_size, drawn) + 1)) AS i FROM h JOIN z ON h.set_key = z.set_key, c),
      p AS (SELECT set_key, overlap, set_size, least(1.0, sum(CASE WHEN drawn - i <= total - set_size THEN exp(
        lgamma(set_size + 1) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(total - set_size + 1) - lgamma(drawn - i + 1) - lgamma(total - set_size - drawn + i + 1)
        - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)) ELSE 0 END)) AS p FROM terms GROUP BY set_key, overlap, set_size),
      r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, set_key) AS a FROM p)
      SELECT set_key, overlap, set_size, round(p, 7) AS p, round(least(1.0, min(a) OVER (ORDER BY p DESC, set_key DESC ROWS UNBOUNDED PRECEDING)), 6) AS padj FROM r""",
    "set_scores": f"""WITH {_RANKED}, h AS (
        SELECT m.set_key, rank, row_number() OVER (PARTITION BY m.set_key ORDER BY rank) AS i, count(*) OVER (PARTITION BY m.set_key) AS n, (SELECT count(*) FROM ranked) AS a FROM members m JOIN ranked r ON m.gene = r.gene),
      s AS (SELECT set_key, n, i * sqrt((a - n) / n) - (rank - i) * sqrt(n / (a - n)) AS at_hit, (i - 1) * sqrt((a - n) / n) - (rank - i) * sqrt(n / (a - n)) AS ahead FROM h WHERE n < a)
      SELECT set_key, max(n) AS n_hits, round(CASE WHEN abs(max(at_hit)) >= abs(min(ahead)) THEN max(at_hit) ELSE min(ahead) END, 5) AS es FROM s GROUP BY set_key""",
    "set_even_scores": f"""WITH {_RANKED}, h AS (
        SELECT m.set_key, rank, row_number() OVER (PARTITION BY m.set_key ORDER BY rank) AS i, count(*) OVER (PARTITION BY m.set_key) AS n, (SELECT count(*) FROM ranked) AS a FROM members m JOIN ranked r ON m.gene = r.gene),
      s AS (SELECT set_key, n, i / n - (rank - i) / (a - n) AS at_hit, (i - 1) / n - (rank - i) / (a - n) AS ahead FROM h WHERE n < a)
      SELECT set_key, max(n) AS n_hits, round(CASE WHEN abs(max(at_hit)) >= abs(min(ahead)) THEN max(at_hit) ELSE min(ahead) END, 6) AS es FROM s GROUP BY set_key""",
    "set_leading_genes": f"""WITH {_RANKED}, h AS (
        SELECT m.set_key, m.gene, rank, row_number() OVER (PARTITION BY m.set_key ORDER BY rank) AS i, count(*) OVER (PARTITION BY m.set_key) AS n, (SELECT count(*) FROM ranked) AS a FROM members m JOIN ranked r ON m.gene = r.gene),
      s AS (SELECT *, i * sqrt((a - n) / n) - (rank - i) * sqrt(n / (a - n)) AS at_hit, (i - 1) * sqrt((a - n) / n) - (rank - i) * sqrt(n / (a - n)) AS ahead FROM h WHERE n < a),
      p AS (SELECT set_key, abs(max(at_hit)) >= abs(min(ahead)) AS rises, arg_max(i, (at_hit, -i)) AS up_to, arg_min(i, (ahead, i)) AS since FROM s GROUP BY set_key)
      SELECT s.set_key, gene, rank FROM s JOIN p USING (set_key) WHERE CASE WHEN rises THEN i <= up_to ELSE i >= since END""",
    "tail_functions": f"""WITH {PEAKS}, v AS (SELECT peak_id, CAST(summit_height AS DOUBLE) AS h FROM peaks),
      n AS (SELECT peak_id, h, (h / 20) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * (h / 20) / sqrt(2.0)) AS t FROM v),
      a AS (SELECT peak_id, h, {_ERFC} AS normal_p FROM n),
      c AS (SELECT peak_id, h, normal_p, sqrt(h / 20) AS x, 1.0 / (1.0 + 0.3275911 * sqrt(h / 20)) AS t FROM a),
      b AS (SELECT peak_id, h, normal_p, {_ERFC} AS chi_p1 FROM c),
      k AS (SELECT DISTINCT h, (h - 0.5 - 20) / sqrt(20.0) AS z FROM v), w AS (SELECT h, z, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM k),
      few AS (SELECT h, 1.0 - sum(CASE WHEN i < h THEN exp(i * ln(20.0) - 20.0 - lgamma(i + 1)) ELSE 0 END) AS tail FROM k, range(0, 50) r(i) WHERE h < 50 GROUP BY h),
      tails AS (SELECT h, tail FROM few UNION ALL SELECT h, 0.5 * {_ERFC} FROM w WHERE h >= 50),
      pois AS (SELECT h, CASE WHEN h <= 0 THEN 0.0 ELSE least(300.0, -log10(greatest(tail, 1e-300))) END AS poisson FROM tails)
      SELECT peak_id, round(normal_p, 6) AS normal_p, round(chi_p1, 6) AS chi_p1, round(exp(-h / 20), 6) AS chi_p2, round(poisson, 5) AS poisson FROM b LEFT JOIN pois USING (h)""",
    "cell_quality": f"""WITH {_COUNTS}, c AS (SELECT user_id, count(DISTINCT feature) AS n_features, CAST(sum(n) AS BIGINT) AS total, round(coalesce(sum(n) FILTER (event_type = 'error'), 0) * 100.0 / sum(n), 6) AS marked_pct FROM counts GROUP BY user_id),
      m AS (SELECT median(n_features) AS med FROM c), d AS (SELECT median(abs(n_features - med)) AS mad FROM c, m)
      SELECT user_id, n_features, total, marked_pct, n_features BETWEEN med - 3 * mad AND med + 5 * mad AND marked_pct <= 20 AS passes FROM c, m, d""",
    "variable_features": f"""WITH {_COUNTS}, t AS (SELECT user_id, sum(n) AS total FROM counts GROUP BY user_id), v AS (SELECT user_id, feature, ln(1 + n * 10000.0 / total) AS value FROM counts JOIN t USING (user_id)),
      k AS (SELECT count(DISTINCT user_id) AS cells FROM v),
      s AS (SELECT feature, sum(value) / max(cells) AS mean, (sum(value * value) - sum(value) * sum(value) / max(cells)) / (max(cells) - 1) AS variance FROM v, k GROUP BY feature),
      l AS (SELECT *, ln(mean) AS lm, ln(greatest(variance, 0.0) + 1e-10) AS lv FROM s WHERE mean > 0),
      b AS (SELECT *, least(19, floor((lm - min(lm) OVER ()) / greatest(max(lm) OVER () - min(lm) OVER (), 1e-12) * 20)) AS bin FROM l),
      w AS (SELECT *, avg(lv) OVER (PARTITION BY bin) AS m, stddev_samp(lv) OVER (PARTITION BY bin) AS d FROM b)
      SELECT feature, round(mean, 5) AS mean, round(variance, 5) AS variance, round(greatest(-10.0, least(10.0, coalesce((lv - m) / CASE WHEN d > 1e-12 THEN d END, 0.0))), 4) AS score FROM w""",
    "cluster_profiles": f"""WITH {_COUNTS}, e AS (SELECT user_id, event_type, sum(n) AS m FROM counts GROUP BY user_id, event_type),
      k AS (SELECT user_id, arg_max(event_type, (m, event_type)) AS cluster FROM e GROUP BY user_id),
      v AS (SELECT user_id, feature, ln(1 + n) - avg(ln(1 + n)) OVER (PARTITION BY user_id) AS value FROM counts),
      z AS (SELECT cluster, count(DISTINCT user_id) AS size FROM k GROUP BY cluster)
      SELECT k.cluster, feature, round(sum(value) / max(size), 5) AS mean, round(count(DISTINCT CASE WHEN value > 0 THEN user_id END) / max(size), 6) AS part FROM v JOIN k USING (user_id) JOIN z ON k.cluster = z.cluster GROUP BY k.cluster, feature""",
    "nearest_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
        SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
      SELECT vec_id, neighbour, rank, round(distance, 4) AS distance FROM r WHERE rank <= 10""",
}
