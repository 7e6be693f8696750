"""Queries of read-level, fitted and joined results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import cells, graphs, models, overlap, reads, testing, variants
from strandline.plans.statistics_queries import _called_genes, _set_members
from strandline.plans.views import CALLS, GENES, PEAKS, SEGMENTS, calls, expression, genes, peaks, segments
from strandline.tables import table


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of single bases as observations of their site."""
    rows = calls(spark, sf_dir, "chrom", "pos", "panel", "qual", "af").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("qual").isNotNull() & ~F.isnan("qual"))
    return rows.withColumn("is_alt", F.coalesce(F.col("af").cast("double") >= 0.5, F.lit(False)) & ~F.isnan(F.coalesce(F.col("af").cast("double"), F.lit(0.0))))


def site_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype of each site called at least three times, calls above one half being alternative."""
    found = reads.genotypes(_observed(spark, sf_dir), by=["chrom", "pos"], is_alt=F.col("is_alt"), quality=F.col("qual"))
    return found.filter(F.col("depth") >= 3).select("chrom", "pos", "depth", "n_alt", "genotype", F.round("quality", 3).alias("quality"))


def tumour_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the tumour panel scored against the germline panel."""
    rows = _observed(spark, sf_dir)
    side = lambda panel: rows.filter(F.col("panel") == panel).groupBy("chrom", "pos").agg(F.count("*").alias("depth"), F.count(F.when(F.col("is_alt"), 1)).alias("n_alt"))
    return reads.contrast_sites(side("tumor"), side("germline"), on=["chrom", "pos"]).select(
        "chrom", "pos", "t_depth", "t_alt", "n_depth", "n_alt", F.round("lod", 5).alias("lod"), "verdict"
    )


def gene_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each gene name: calls, copies, intervals; from any of the three."""
    called = calls(spark, sf_dir, "gene").filter(F.col("gene") != "").groupBy("gene").agg(F.count("*").alias("n_calls"))
    copies = segments(spark, sf_dir).filter(F.col("gene") != "").groupBy("gene").agg(F.count("*").alias("n_segments"), F.round(F.avg(F.col("copy_number").cast("double")), 5).alias("copies"))
    placed = genes(spark, sf_dir).filter(F.col("gene_name") != "").groupBy(F.col("gene_name").alias("gene")).agg(F.count("*").alias("n_intervals"))
    joined = called.join(copies, "gene", "full_outer").join(placed, "gene", "full_outer")
    state = (
        F.when((F.col("copies") < 1.5) & (F.col("n_calls") > 0), "lost_and_called").when(F.col("copies") >= 4.5, "amplified").when(F.col("n_calls") > 0, "called").when(F.col("n_segments") > 0, "copied").otherwise("placed")
    )
    return joined.select("gene", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), "copies", F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"), state.alias("state"))


def calls_at_gene_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each gene interval, the first call within one base of its start."""
    starts = genes(spark, sf_dir).select("interval_id", "chrom", F.explode(F.array(*[F.col("start_pos") + d for d in (-1, 0, 1)])).alias("pos"))
    found = starts.join(calls(spark, sf_dir, "chrom", "pos").select("chrom", "pos", "record_id"), ["chrom", "pos"])
    return found.groupBy("interval_id").agg(F.min(F.struct("pos", "record_id")).alias("_x")).select("interval_id", F.col("_x.pos").alias("pos"), F.col("_x.record_id").alias("record_id"))


def peak_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest stack of overlapping peaks on each chromosome of a run, by running sums of starts and ends."""
    return overlap.deepest_stack(peaks(spark, sf_dir).select("peak_id", "run_id", "chrom", "start_pos", "end_pos"), entity=["run_id", "chrom"], start="start_pos", end="end_pos")


def value_under_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under each user's values over time, by trapezoids, in value hours."""
    rows = table(spark, sf_dir, "events").filter(F.col("ts").isNotNull() & F.col("value").isNotNull()).select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("_s"))
    found = overlap.area_under(rows, entity=["user_id"], order=["_s", "event_id"], x=F.col("_s") / 3.6e9, y=F.col("value"))
    return found.select("user_id", F.col("n_rows").alias("n_events"), F.round("area", 3).alias("area"))


def chromosome_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly the calls of each sample lie over chromosomes (population deviation over mean)."""
    counts = calls(spark, sf_dir, "chrom", "sample_id").filter(F.col("chrom").isNotNull()).groupBy("sample_id", "chrom").agg(F.count("*").alias("n"))
    return counts.groupBy("sample_id").agg(F.count("*").alias("n_chroms"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("variation"))


def approximate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct called positions by a mergeable sketch, per cohort (about 0.8 % off)."""
    return variants.approx_sites(calls(spark, sf_dir, "chrom", "pos", "cohort"), ["cohort"])


def spectrum_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples' substitution spectra as mixtures of the panels' spectra."""
    rows = calls(spark, sf_dir, "ref_allele", "alt_allele", "sample_id", "panel")
    samples, panels = variants.substitution_spectrum(rows, ["sample_id"]), variants.substitution_spectrum(rows, ["panel"])
    found = models.exposures(samples.filter(F.col("sample_id").isNotNull()), panels.filter(F.col("panel").isNotNull()), sample="sample_id", signature="panel")
    return found.select("sample_id", F.col("signature").alias("panel"), F.round("weight", 6).alias("weight"), F.round("cosine", 6).alias("cosine"))


def vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two principal components of the embeddings."""
    found = models.principal_components(table(spark, sf_dir, "embeddings"), vector="embedding", k=2, keep=["vec_id", "label"])
    return found.select("vec_id", "label", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


def expression_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative-binomial contrast of even against odd samples of each gene."""
    rows = expression(spark, sf_dir).withColumn("count", F.round(F.col("value") * 10)).withColumn("treated", (F.col("sample_no") % 2).cast("double"))
    key = ["batch_id", "gene_id"]
    factors = testing.size_factors(rows, gene=key, sample=["batch_id", "sample_no"], value="count")
    spread = models.dispersion_trend(rows, gene=key, value="count").select(*key, "shrunk")
    ready = rows.join(factors, ["batch_id", "sample_no"]).join(spread, key)
    found = models.count_models(ready.select(*key, "sample_no", "count", "treated", "size_factor", "shrunk"), gene=key, sample="sample_no", value="count", treated="treated", size="size_factor", dispersion="shrunk")
    return found.select(*key, F.round("log2fc", 4).alias("log2fc"), F.round("se", 4).alias("se"), F.round("wald", 4).alias("wald"))


def set_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment scores of the reference sets along all called genes, with permutation p-values."""
    ranked = testing.ranked_all(_called_genes(spark, sf_dir), score="n", key="gene")
    scored = testing.enrichment_scores(ranked, _set_members(spark, sf_dir), set_key="set_key")
    tested = models.permutation_p_values(scored, set_key="set_key", size="n_hits", score="es", n_ranked=ranked.count())
    return testing.adjust_p_values(tested.select("set_key", "n_hits", "es", "nes", "p"), p="p", family=[]).select(
        "set_key", "n_hits", F.round("es", 5).alias("es"), F.round("nes", 5).alias("nes"), F.round("p", 6).alias("p"), F.round("padj", 6).alias("padj")
    )


def genotype_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled likelihoods of the three genotypes of each site called at least three times."""
    found = reads.genotype_likelihoods(_observed(spark, sf_dir), by=["chrom", "pos"], is_alt=F.col("is_alt"), quality=F.col("qual"))
    return found.filter(F.col("depth") >= 3).select("chrom", "pos", F.col("pl")[0].alias("pl0"), F.col("pl")[1].alias("pl1"), F.col("pl")[2].alias("pl2"))


def strand_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether alternatives lean to one cohort, taken as strands, at sites called four times or more."""
    rows = _observed(spark, sf_dir).join(calls(spark, sf_dir, "cohort"), "record_id").withColumn("is_reverse", F.col("cohort") == "control")
    found = reads.strand_bias(rows.filter(F.col("is_reverse").isNotNull()), by=["chrom", "pos"], is_alt=F.col("is_alt"), is_reverse=F.col("is_reverse"))
    return found.filter(F.col("depth") >= 4).select("chrom", "pos", "depth", F.round("chi_square", 5).alias("chi_square"), "biased")


def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between each vector and its five nearest."""
    return _edges(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cells.fuzzy_edges(cells.nearest_neighbours(rows, rows, key="vec_id", vector="embedding", k=5), key="vec_id")


def label_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I of the vectors' labels over the neighbour edges."""
    found = graphs.moran_index(_edges(spark, sf_dir), table(spark, sf_dir, "embeddings"), node="vec_id", value="label")
    return found.select("n_nodes", F.round("moran", 5).alias("moran"))


def neighbour_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all vectors, by the edges between each and its five nearest."""
    return graphs.communities(_edges(spark, sf_dir))


def segments_over_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes under the segments of each profile: how many, how many bases, by class."""
    placed = genes(spark, sf_dir).select("chrom", F.col("start_pos").alias("gene_start"), F.col("end_pos").alias("gene_end"), "gene_id")
    rows = segments(spark, sf_dir).filter(F.col("chrom").isNotNull()).select("profile_id", "cn_class", "chrom", "start_pos", "end_pos")
    found = overlap.overlap_join(rows, placed, left_span=("start_pos", "end_pos"), right_span=("gene_start", "gene_end"), bin_width=1 << 20)
    shared = F.least("end_pos", "gene_end") - F.greatest("start_pos", "gene_start")
    return found.groupBy("profile_id", "cn_class").agg(F.count_distinct("gene_id").alias("n_genes"), F.sum(shared).alias("shared_bases"))


QUERIES = {
    f.__name__: f
    for f in (
        site_genotypes,
        tumour_sites,
        gene_evidence,
        calls_at_gene_starts,
        peak_depth,
        value_under_curve,
        chromosome_spread,
        approximate_sites,
        spectrum_exposures,
        vector_components,
        expression_models,
        set_p_values,
        genotype_likelihoods,
        strand_bias,
        neighbour_edges,
        label_autocorrelation,
        neighbour_communities,
        segments_over_genes,
    )
}
_OBSERVED = f"""{CALLS}, observed AS (
  SELECT *, coalesce(CAST(af AS DOUBLE) >= 0.5 AND NOT isnan(af), false) AS is_alt FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL AND qual IS NOT NULL AND NOT isnan(qual))"""
_EDGES_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
        SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id),
      r AS (SELECT *, exp(-distance) AS w FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 5),
      g AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, coalesce(max(w) FILTER (a < b), 0.0) AS x, coalesce(max(w) FILTER (a > b), 0.0) AS y FROM r GROUP BY ALL),
      edges AS (SELECT src, dst, x + y - x * y AS weight FROM g)
"""
_ODDS = lambda d, a: f"({a} * log10(greatest(0.001, least(0.999, {a} / {d})) / 0.001) + ({d} - {a}) * log10((1 - greatest(0.001, least(0.999, {a} / {d}))) / 0.999))"
SQL = {
    "site_genotypes": f"""WITH {_OBSERVED}, e AS (SELECT chrom, pos, is_alt, pow(10.0, -greatest(least(CAST(qual AS DOUBLE), 60.0), 1.0) / 10) AS e FROM observed),
      l AS (SELECT chrom, pos, count(*) AS depth, count(*) FILTER (is_alt) AS n_alt, sum(CASE WHEN is_alt THEN ln(e) ELSE ln(1 - e) END) + ln(1 - 0.0015) AS l0, count(*) * ln(0.5) + ln(0.001) AS l1,
        sum(CASE WHEN is_alt THEN ln(1 - e) ELSE ln(e) END) + ln(0.0005) AS l2 FROM e GROUP BY chrom, pos HAVING count(*) >= 3),
      b AS (SELECT *, greatest(l0, l1, l2) AS best FROM l)
      SELECT chrom, pos, depth, n_alt, CASE best WHEN l0 THEN 0 WHEN l1 THEN 1 ELSE 2 END AS genotype,
        round(least(999.0, 10 * (best - CASE best WHEN l0 THEN greatest(l1, l2) WHEN l1 THEN greatest(l0, l2) ELSE greatest(l0, l1) END) / ln(10)), 3) AS quality FROM b""",
    "genotype_likelihoods": f"""WITH {_OBSERVED}, e AS (SELECT chrom, pos, is_alt, pow(10.0, -greatest(least(CAST(qual AS DOUBLE), 60.0), 1.0) / 10) AS e FROM observed),
      l AS (SELECT chrom, pos, sum(CASE WHEN is_alt THEN ln(e) ELSE ln(1 - e) END) AS l0, count(*) * ln(0.5) AS l1, sum(CASE WHEN is_alt THEN ln(1 - e) ELSE ln(e) END) AS l2 FROM e GROUP BY chrom, pos HAVING count(*) >= 3),
      b AS (SELECT *, greatest(l0, l1, l2) AS m FROM l)
      SELECT chrom, pos, CAST(round(-10 * (l0 - m) / ln(10)) AS BIGINT) AS pl0, CAST(round(-10 * (l1 - m) / ln(10)) AS BIGINT) AS pl1, CAST(round(-10 * (l2 - m) / ln(10)) AS BIGINT) AS pl2 FROM b""",
    "strand_bias": f"""WITH {_OBSERVED}, t AS (SELECT chrom, pos, count(*) FILTER (is_alt AND cohort = 'control') AS a, count(*) FILTER (is_alt AND cohort <> 'control') AS b, count(*) FILTER (NOT is_alt AND cohort = 'control') AS c, count(*) FILTER (NOT is_alt AND cohort <> 'control') AS d
        FROM observed WHERE cohort IS NOT NULL GROUP BY chrom, pos HAVING count(*) >= 4),
      x AS (SELECT *, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN CAST(a + b + c + d AS DOUBLE) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)) ELSE 0.0 END AS q FROM t)
      SELECT chrom, pos, a + b + c + d AS depth, round(q, 5) AS chi_square, q > 10.8276 AS biased FROM x""",
    "tumour_sites": f"""WITH {_OBSERVED}, s AS (SELECT panel, chrom, pos, count(*) AS d, count(*) FILTER (is_alt) AS a FROM observed GROUP BY ALL),
      b AS (SELECT t.chrom, t.pos, t.d AS t_depth, t.a AS t_alt, n.d AS n_depth, n.a AS n_alt, {_ODDS("t.d", "t.a")} AS lod FROM s t JOIN s n ON t.chrom = n.chrom AND t.pos = n.pos AND t.panel = 'tumor' AND n.panel = 'germline')
      SELECT chrom, pos, t_depth, t_alt, n_depth, n_alt, round(lod, 5) AS lod, CASE WHEN lod < 6.3 THEN 'weak' WHEN n_alt / n_depth > 0.03 THEN 'in_normal' ELSE 'pass' END AS verdict FROM b""",
    "gene_evidence": f"""WITH {CALLS}, {SEGMENTS}, {GENES}, c AS (SELECT gene, count(*) AS n_calls FROM calls WHERE gene <> '' GROUP BY gene),
      s AS (SELECT gene, count(*) AS n_segments, round(avg(CAST(copy_number AS DOUBLE)), 5) AS copies FROM segments WHERE gene <> '' GROUP BY gene),
      g AS (SELECT gene_name AS gene, count(*) AS n_intervals FROM genes WHERE gene_name <> '' GROUP BY gene_name),
      j AS (SELECT * FROM c FULL JOIN s USING (gene) FULL JOIN g USING (gene))
      SELECT gene, coalesce(n_calls, 0) AS n_calls, coalesce(n_segments, 0) AS n_segments, copies, coalesce(n_intervals, 0) AS n_intervals,
        CASE WHEN copies < 1.5 AND n_calls > 0 THEN 'lost_and_called' WHEN copies >= 4.5 THEN 'amplified' WHEN n_calls > 0 THEN 'called' WHEN n_segments > 0 THEN 'copied' ELSE 'placed' END AS state FROM j""",
    "calls_at_gene_starts": f"""WITH {CALLS}, {GENES}, h AS (SELECT g.interval_id, c.pos, c.record_id FROM genes g JOIN calls c ON g.chrom = c.chrom AND c.pos BETWEEN g.start_pos - 1 AND g.start_pos + 1)
      SELECT interval_id, arg_min(pos, (pos, record_id)) AS pos, arg_min(record_id, (pos, record_id)) AS record_id FROM h GROUP BY interval_id""",
    "peak_depth": f"""WITH {PEAKS}, e AS (SELECT run_id, chrom, start_pos AS x, 1 AS d FROM peaks UNION ALL SELECT run_id, chrom, end_pos, -1 FROM peaks),
      s AS (SELECT run_id, chrom, x, sum(d) AS d FROM e GROUP BY ALL), r AS (SELECT run_id, chrom, sum(d) OVER (PARTITION BY run_id, chrom ORDER BY x ROWS UNBOUNDED PRECEDING) AS depth FROM s)
      SELECT run_id, chrom, CAST(max(depth) AS BIGINT) AS deepest FROM r GROUP BY run_id, chrom""",
    "value_under_curve": """WITH p AS (SELECT user_id, (value + lag(value) OVER w) / 2 * (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS a FROM events WHERE ts IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT user_id, count(*) AS n_events, round(coalesce(sum(a), 0.0), 3) AS area FROM p GROUP BY user_id""",
    "chromosome_spread": f"""WITH {CALLS}, c AS (SELECT sample_id, chrom, count(*) AS n FROM calls WHERE chrom IS NOT NULL GROUP BY sample_id, chrom)
      SELECT sample_id, count(*) AS n_chroms, round(stddev_pop(n) / avg(n), 6) AS variation FROM c GROUP BY sample_id""",
    "neighbour_edges": _EDGES_SQL + "SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "label_autocorrelation": _EDGES_SQL
    + """SELECT max(n) AS n_nodes, round(sum(weight * (a.label - m) * (b.label - m)) / (sum(weight) * max(s)), 5) AS moran FROM edges
      JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst, (SELECT avg(label) AS m, count(label) AS n, var_pop(label) AS s FROM embeddings)""",
    "segments_over_genes": f"""WITH {SEGMENTS}, {GENES}
      SELECT profile_id, cn_class, count(DISTINCT gene_id) AS n_genes, CAST(sum(least(s.end_pos, g.end_pos) - greatest(s.start_pos, g.start_pos)) AS BIGINT) AS shared_bases
      FROM segments s JOIN genes g ON s.chrom = g.chrom AND s.start_pos < g.end_pos AND g.start_pos < s.end_pos GROUP BY profile_id, cn_class""",
}
