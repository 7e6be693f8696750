"""Queries that write the given tables in a public format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import copynumber, reads
from strandline.plans.derived import as_file, derived_bases, sql_bases
from strandline.plans.views import CALLS, EXPRESSION, GENES, PEAKS, SEGMENTS, calls, expression, genes, peaks, segments
from strandline.sources import sinks, text
from strandline.tables import table

#: Values that a tab-separated file can hold as they are.
_PLAIN = r"^[^\t\r\n;|]+$"


def _tabbed(*columns: object) -> F.Column:
    return F.concat_ws("\t", *columns).alias("value")


def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by way of VCF: per chromosome, how many, with what quality, frequency and gene."""
    rows = calls(spark, sf_dir, "chrom", "pos", "ref_allele", "alt_allele", "qual", "af", "gene").filter(F.col("chrom").isNotNull() & F.col("alt_allele").rlike(_PLAIN) & F.col("ref_allele").rlike(_PLAIN))
    gene = F.when(F.col("gene").rlike(_PLAIN), F.concat(F.lit("GENE="), F.col("gene")))
    info = F.concat_ws(";", F.lit("DP=7"), F.concat(F.lit("AF="), F.col("af").cast("string")), gene)
    number = F.when(F.col("qual").isNotNull() & ~F.isnan("qual"), F.col("qual").cast("string")).otherwise(".")
    lines = rows.select(_tabbed(F.concat(F.lit("chr"), F.col("chrom")), F.coalesce(F.col("pos").cast("string"), F.lit("none")), F.lit("."), "ref_allele", "alt_allele", number, F.lit("PASS"), info))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string")
    read = text.read_vcf(spark, as_file(head.unionByName(lines), "vcf"))
    known = F.when(~F.isnan("af"), F.col("af").cast("double"))
    return read.groupBy("chrom").agg(
        F.count("*").alias("n_calls"), F.sum("pos").alias("positions"), F.round(F.avg(F.col("qual").cast("double")), 4).alias("quality"), F.count(known).alias("n_af"), F.round(F.avg(known), 5).alias("frequency"), F.count("gene").alias("n_gene")
    )


def cnv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by way of CNV VCF, with the class of their ratio."""
    rows = segments(spark, sf_dir).filter(F.col("chrom").isNotNull() & F.col("copy_number").isNotNull() & ~F.isnan("copy_number"))
    ratio = F.when(F.col("log2_ratio").isNotNull() & ~F.isnan("log2_ratio"), F.concat(F.lit("LOG2="), F.col("log2_ratio").cast("string")))
    info = F.concat_ws(";", F.concat(F.lit("END="), F.col("end_pos").cast("string")), F.concat(F.lit("CN="), F.col("copy_number").cast("string")), ratio, F.lit("SVTYPE=CNV"))
    read = text.read_cnv_vcf(spark, as_file(rows.select(_tabbed("chrom", F.col("start_pos").cast("string"), "segment_id", F.lit("N"), F.lit("<CNV>"), F.lit("."), F.lit("PASS"), info)), "cnv"))
    return read.groupBy("chrom", copynumber.ratio_class(F.col("log2_ratio")).alias("kind")).agg(F.count("*").alias("n_segments"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_bases"), F.round(F.avg(F.col("copy_number").cast("double")), 4).alias("copies"))


def expression_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression by way of a table of genes and samples: mean of each sample of each batch's genes."""
    rows = expression(spark, sf_dir).filter(F.col("sample_no") <= 6)
    wide = rows.groupBy(F.concat_ws("|", "batch_id", "gene_id").alias("gene")).pivot("sample_no", list(range(1, 7))).agg(F.max("value"))
    head = spark.createDataFrame([("\t".join(["gene", *[f"S{i}" for i in range(1, 7)]]),)], "value string")
    lines = wide.select(_tabbed("gene", *[F.coalesce(F.col(str(i)).cast("string"), F.lit("NA")) for i in range(1, 7)]))
    read = text.read_expression(spark, as_file(head.unionByName(lines), "expression"))
    return read.groupBy("sample_id").agg(F.count("*").alias("n_genes"), F.round(F.avg("value"), 5).alias("mean"), F.count(F.when(F.col("value") >= 1, 1)).alias("n_expressed"))


def methylation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called frequencies as methylation sites by way of BED: level of each chromosome."""
    rows = calls(spark, sf_dir, "chrom", "pos", "af").filter(F.col("chrom").isNotNull() & (F.col("pos") >= 0) & (F.col("af") <= 1) & (F.col("af") >= 0))
    lines = rows.select(_tabbed("chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.lit("."), F.round(F.col("af").cast("double") * 1000, 3).cast("string"), F.lit("+")))
    read = text.read_methylation(spark, as_file(lines, "methylation"))
    return read.groupBy("chrom").agg(F.count("*").alias("n_sites"), F.round(F.avg("methylation"), 4).alias("level"), F.count(F.when(F.col("methylation") > 80, 1)).alias("n_high"), F.count(F.when(F.col("methylation") < 20, 1)).alias("n_low"))


def gmt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference gene sets by way of GMT: size of each."""
    rows = table(spark, sf_dir, "ref_gene_sets").select("set_key", "genes").distinct()
    clean = F.filter("genes", lambda g: g.rlike(r"^[^\t\r\n]+$"))
    read = text.read_gmt(spark, as_file(rows.select(F.concat_ws("\t", "set_key", F.lit("about"), clean).alias("value")), "gmt"))
    return read.select(F.col("set_name").alias("set_key"), F.size("genes").cast("long").alias("n_genes"), F.size(F.array_distinct("genes")).cast("long").alias("n_distinct"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene intervals as exons of one transcript a gene, by way of GTF."""
    rows = genes(spark, sf_dir).filter(F.col("gene_id").rlike(r"^[^\t\r\n\";]+$"))
    name = F.when(F.col("gene_name").rlike(r"^[^\t\r\n\";]+$"), F.concat(F.lit('gene_name "'), F.col("gene_name"), F.lit('";')))
    attributes = F.concat_ws(" ", F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('";')), F.concat(F.lit('transcript_id "'), F.col("gene_id"), F.lit(":"), F.col("chrom"), F.lit('";')), name)
    lines = rows.select(_tabbed("chrom", F.lit("strandline"), F.lit("exon"), (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), attributes))
    return text.read_features(spark, as_file(lines, "gtf"))


def gene_spans_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes from their first to their last exon."""
    return text.gene_spans(_features(spark, sf_dir)).select("gene_id", "start_pos", "end_pos", "gene_name")


def splice_junctions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions between neighbouring exons of a gene that do not overlap."""
    return text.splice_junctions(_features(spark, sf_dir)).select("transcript_id", "donor", "acceptor")


def read_quality_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 32 derived bases by way of FASTQ: numbers, GC and high quality."""
    rows = calls(spark, sf_dir, "pos").filter(F.col("pos").isNotNull())
    bases = derived_bases(F.col("record_id").cast("string"))
    quality = F.translate(F.md5(F.concat(F.lit("q"), F.col("record_id").cast("string"))), "0123456789abcdef", "!#%')+-/13579;=?"[:16])
    record = F.concat(F.lit("@"), F.col("record_id").cast("string"), F.lit("\n"), bases, F.lit("\n+\n"), quality)
    return text.fastq_quality(spark, as_file(rows.select(record.alias("value")), "fastq")).select("n_reads", "n_bases", "mean_length", F.round("gc_pct", 5).alias("gc_pct"), F.round("q30_pct", 5).alias("q30_pct"))


def sequence_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences derived from the gene names by way of FASTA: length and bases of each."""
    rows = genes(spark, sf_dir).filter(F.col("gene_name").rlike(r"^\S+$")).select("gene_name").distinct()
    first, second = derived_bases(F.col("gene_name")), F.lower(derived_bases(F.concat("gene_name", F.lit("2"))))
    read = text.read_fasta(spark, as_file(rows.select(F.concat(F.lit(">"), F.col("gene_name"), F.lit(" about it\n"), first, F.lit("\n"), second).alias("value")), "fasta"))
    return read.select("name", F.length("sequence").cast("long").alias("n_bases"), F.length(F.regexp_replace("sequence", "[^GC]", "")).cast("long").alias("n_gc"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull() & F.col("event_type").isNotNull()).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _matrix(spark: SparkSession, sf_dir: str) -> str:
    """Users' event counts as a 10x matrix directory (a user's number is the line of its barcode)."""
    counts = _events(spark, sf_dir)
    users = table(spark, sf_dir, "events").agg(F.max("user_id").alias("_m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("user_id"))
    kinds = counts.select("event_type").distinct().withColumn("feature_no", F.row_number().over(W.orderBy("event_type")))
    folder = as_file(users.repartitionByRange("user_id").sortWithinPartitions("user_id").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("value")), "mex/barcodes")
    root, name = folder.rsplit("/", 1)[0], folder.rsplit("-", 1)[1]
    kinds.coalesce(1).sortWithinPartitions("feature_no").select(_tabbed(F.concat(F.lit("F"), F.col("feature_no").cast("string")), "event_type")).write.text(f"{root}/features-{name}")
    body = counts.join(kinds, "event_type").select(F.concat_ws(" ", F.col("feature_no").cast("string"), (F.col("user_id") + 1).cast("string"), F.col("n").cast("string")).alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), ("1 1 1",)], "value string").coalesce(1)
    head.unionByName(body).write.text(f"{root}/matrix-{name}")
    return f"{root}/{{}}-{name}"


def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event counts by way of a 10x matrix."""
    at = _matrix(spark, sf_dir)
    read = text.read_mex(spark, "", names={k: at.format(k) for k in ("barcodes", "features", "matrix")})
    return read.groupBy("feature").agg(F.count("*").alias("n_cells"), F.sum("n").alias("total"), F.max("n").alias("most"))


def spot_counts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as spots: positions and count matrices by way of their files; totals of those in tissue."""
    at = _matrix(spark, sf_dir)
    users = _events(spark, sf_dir).select("user_id").distinct()
    lines = users.select(F.concat_ws(",", F.concat(F.lit("U"), F.col("user_id").cast("string")), F.when(F.col("user_id") % 3 == 0, "0").otherwise("1"), F.lit("0"), F.lit("0"), (F.col("user_id") * 2).cast("string"), (F.col("user_id") + 5).cast("string")).alias("value"))
    head = spark.createDataFrame([("barcode,in_tissue,array_row,array_col,pxl_row,pxl_col",)], "value string")
    spots = text.read_spots(spark, as_file(head.unionByName(lines), "spots"))
    totals = text.read_mex(spark, "", names={k: at.format(k) for k in ("barcodes", "features", "matrix")}).groupBy("barcode").agg(F.sum("n").alias("total"))
    return spots.join(totals, "barcode").select("barcode", "x", "y", "total")


def antibody_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event counts by way of a comma-separated matrix: totals of each column."""
    kinds = ["click", "error", "purchase", "view"]
    wide = _events(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).agg(F.max("n"))
    head = spark.createDataFrame([(",".join(["cell", *kinds]),)], "value string")
    lines = wide.select(F.concat_ws(",", F.concat(F.lit("U"), F.col("user_id").cast("string")), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in kinds]).alias("value"))
    read = text.read_counts_table(spark, as_file(head.unionByName(lines), "antibodies"))
    return read.groupBy("feature").agg(F.count("*").alias("n_cells"), F.sum("n").cast("long").alias("total"))


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the peak runs written as JSON and read again."""
    rows = peaks(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n_peaks"), F.max("summit_height").alias("highest"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_bases"))
    lines = rows.select(F.to_json(F.struct("run_id", "n_peaks", "highest", "n_bases")).alias("value"))
    return text.read_summaries(spark, as_file(lines, "summaries"), "run_id string, n_peaks long, highest int, n_bases long")


def chromosome_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes in their natural order, numbered."""
    names = calls(spark, sf_dir, "chrom").filter(F.col("chrom").isNotNull()).select("chrom").distinct()
    return names.select("chrom", F.row_number().over(W.orderBy(sinks.chromosome_order(F.col("chrom")))).cast("long").alias("place"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 32 derived bases at the called positions by way of SAM: 12 matched, 2 inserted, 3 deleted, 18 matched."""
    rows = calls(spark, sf_dir, "chrom", "pos").filter(F.col("chrom").isNotNull() & (F.col("pos") > 0))
    number = F.col("record_id").cast("string")
    flag = F.when(F.col("record_id") % 11 == 0, "1024").when(F.col("record_id") % 2 == 0, "16").otherwise("0")
    quality = F.translate(F.md5(F.concat(F.lit("q"), number)), "0123456789abcdef", "!#%')+-/13579;=?")
    at = (F.floor(F.col("pos") / 40) * 40 + 1).cast("string")
    lines = rows.select(_tabbed(number, flag, "chrom", at, F.when(F.col("record_id") % 7 == 0, "10").otherwise("60"), F.lit("12M2I3D18M"), F.lit("*"), F.lit("0"), F.lit("0"), derived_bases(number), quality))
    head = spark.createDataFrame([("@HD\tVN:1.6",)], "value string")
    return reads.usable_reads(reads.read_sam(spark, as_file(head.unionByName(lines), "sam")))


def read_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of the reads over each position: depth, letters, reverse strand; per chromosome the sums."""
    piled = reads.pileup(reads.aligned_bases(_reads(spark, sf_dir), least_quality=20))
    return piled.groupBy("chrom").agg(F.count("*").alias("n_sites"), F.sum("depth").alias("n_bases"), F.max("depth").alias("deepest"), F.sum("n_a").alias("n_a"), F.sum("n_g").alias("n_g"), F.sum("n_reverse").alias("n_reverse"), F.sum(F.col("pos") * F.col("depth")).alias("weighted"))


def read_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of reads and of the reference that their CIGARs take up, by strand."""
    rows = _reads(spark, sf_dir)
    return rows.groupBy((F.col("flag") == 16).alias("is_reverse")).agg(F.count("*").alias("n_reads"), F.sum(reads.query_length(F.col("cigar"))).alias("query"), F.sum(reads.reference_length(F.col("cigar"))).alias("reference"))


def read_methylation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified cytosines of the reads by their tags: the second, third and fifth of each read; per chromosome the sums."""
    rows = calls(spark, sf_dir, "chrom", "pos").filter(F.col("chrom").isNotNull() & (F.col("pos") > 0))
    number = F.col("record_id").cast("string")
    flag = F.when(F.col("record_id") % 2 == 0, "16").otherwise("0")
    tags = [F.lit("MM:Z:A+a,0;C+m,1,0,1;"), F.concat(F.lit("ML:B:C,9,"), (F.col("record_id") % 200).cast("string"), F.lit(",100,50"))]
    lines = rows.select(_tabbed(number, flag, "chrom", F.col("pos").cast("string"), F.lit("60"), F.lit("12M2I3D18M"), F.lit("*"), F.lit("0"), F.lit("0"), derived_bases(number), F.lit("I" * 32), *tags))
    sites = reads.methylation_rows(reads.methylation_calls(reads.usable_reads(reads.read_sam(spark, as_file(lines, "long")))))
    return sites.groupBy("chrom").agg(F.count("*").alias("n_sites"), F.sum("start_pos").alias("positions"), F.round(F.avg("methylation"), 4).alias("level"))


QUERIES = {
    f.__name__: f
    for f in (
        vcf_file,
        cnv_file,
        expression_file,
        methylation_file,
        gmt_file,
        gene_spans_file,
        splice_junctions_file,
        read_quality_file,
        sequence_file,
        matrix_file,
        spot_counts_file,
        antibody_file,
        summary_file,
        chromosome_order,
        read_pileup,
        read_lengths,
        read_methylation,
    )
}
_P = r"'^[^\t\r\n;|]+$'"
_Q = "translate(md5('q' || CAST(record_id AS VARCHAR)), '0123456789abcdef', '!#%'')+-/13579;=?')"
_READS = f"""{CALLS}, reads AS (SELECT record_id, chrom, CAST(floor(pos / 40) AS BIGINT) * 40 + 1 AS p, record_id % 2 = 0 AS rev, {sql_bases("CAST(record_id AS VARCHAR)")} AS s, {_Q} AS q
  FROM calls WHERE chrom IS NOT NULL AND pos > 0 AND record_id % 11 <> 0 AND record_id % 7 <> 0)"""
_COUNTS = "counts AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)"
SQL = {
    "vcf_file": f"""WITH {CALLS} SELECT 'chr' || chrom AS chrom, count(*) AS n_calls, CAST(sum(pos) AS BIGINT) AS positions, round(avg(CAST(CASE WHEN qual IS NULL OR isnan(qual) THEN 0 ELSE qual END AS DOUBLE)), 4) AS quality,
      count(*) FILTER (NOT isnan(af)) AS n_af, round(avg(CAST(af AS DOUBLE)) FILTER (NOT isnan(af)), 5) AS frequency, count(*) FILTER (regexp_matches(gene, {_P})) AS n_gene
      FROM calls WHERE chrom IS NOT NULL AND pos IS NOT NULL AND regexp_matches(alt_allele, {_P}) AND regexp_matches(ref_allele, {_P}) GROUP BY chrom""",
    "cnv_file": f"""WITH {SEGMENTS} SELECT chrom, CASE WHEN log2_ratio IS NULL OR isnan(log2_ratio) THEN NULL WHEN log2_ratio > 0.7::FLOAT THEN 'highamp' WHEN log2_ratio > 0.3::FLOAT THEN 'lowamp' WHEN log2_ratio < -0.3::FLOAT THEN 'hetdel' ELSE 'diploid' END AS kind,
      count(*) AS n_segments, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_bases, round(avg(CAST(copy_number AS DOUBLE)), 4) AS copies FROM segments WHERE chrom IS NOT NULL AND copy_number IS NOT NULL AND NOT isnan(copy_number) GROUP BY ALL""",
    "expression_file": f"""WITH {EXPRESSION}, g AS (SELECT DISTINCT batch_id, gene_id FROM expression WHERE sample_no <= 6), c AS (SELECT g.batch_id, g.gene_id, i FROM g, range(1, 7) r(i)),
      v AS (SELECT c.i, coalesce(max(value), 0.0) AS v FROM c LEFT JOIN expression e ON e.batch_id = c.batch_id AND e.gene_id = c.gene_id AND e.sample_no = c.i GROUP BY c.batch_id, c.gene_id, c.i)
      SELECT 'S' || i AS sample_id, count(*) AS n_genes, round(avg(v), 5) AS mean, count(*) FILTER (v >= 1) AS n_expressed FROM v GROUP BY i""",
    "methylation_file": f"""WITH {CALLS}, s AS (SELECT chrom, round(CAST(af AS DOUBLE) * 1000, 3) / 10 AS m FROM calls WHERE chrom IS NOT NULL AND pos >= 0 AND af BETWEEN 0 AND 1)
      SELECT chrom, count(*) AS n_sites, round(avg(m), 4) AS level, count(*) FILTER (m > 80) AS n_high, count(*) FILTER (m < 20) AS n_low FROM s GROUP BY chrom""",
    "gmt_file": r"""WITH s AS (SELECT DISTINCT set_key, genes FROM ref_gene_sets), c AS (SELECT set_key, list_filter(list_transform(list_filter(genes, lambda g: g IS NOT NULL AND regexp_matches(g, '^[^\t\r\n]+$')), lambda g: upper(trim(g))), lambda g: g <> '') AS g FROM s)
      SELECT set_key, len(g) AS n_genes, len(list_distinct(g)) AS n_distinct FROM c""",
    "gene_spans_file": f"WITH {GENES} SELECT gene_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(gene_name) FILTER (gene_name <> '') AS gene_name FROM genes GROUP BY gene_id",
    "splice_junctions_file": f"""WITH {GENES}, p AS (SELECT gene_id || ':' || chrom AS transcript_id, end_pos AS donor, lead(start_pos) OVER (PARTITION BY gene_id, chrom ORDER BY start_pos, end_pos) AS acceptor FROM genes)
      SELECT transcript_id, donor, acceptor FROM p WHERE acceptor > donor""",
    "read_quality_file": f"""WITH {CALLS}, r AS (SELECT {sql_bases("CAST(record_id AS VARCHAR)")} AS s, {_Q} AS q FROM calls WHERE pos IS NOT NULL)
      SELECT count(*) AS n_reads, count(*) * 32 AS n_bases, 32.0 AS mean_length, round(sum(length(regexp_replace(s, '[^GC]', '', 'g'))) * 100.0 / (count(*) * 32), 5) AS gc_pct, round(sum(length(regexp_replace(q, '[^?]', '', 'g'))) * 100.0 / (count(*) * 32), 5) AS q30_pct FROM r""",
    "sequence_file": rf"""WITH {GENES}, n AS (SELECT DISTINCT gene_name AS name FROM genes WHERE regexp_matches(gene_name, '^\S+$')), s AS (SELECT name, {sql_bases("name")} || {sql_bases("name || '2'")} AS s FROM n)
      SELECT name, length(s) AS n_bases, length(regexp_replace(s, '[^GC]', '', 'g')) AS n_gc FROM s""",
    "matrix_file": f"WITH {_COUNTS} SELECT event_type AS feature, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM counts GROUP BY event_type",
    "spot_counts_file": f"WITH {_COUNTS} SELECT 'U' || user_id AS barcode, CAST(user_id + 5 AS DOUBLE) AS x, CAST(user_id * 2 AS DOUBLE) AS y, CAST(sum(n) AS BIGINT) AS total FROM counts WHERE user_id % 3 <> 0 GROUP BY user_id",
    "antibody_file": f"""WITH {_COUNTS}, u AS (SELECT DISTINCT user_id FROM counts), k AS (SELECT unnest(['click', 'error', 'purchase', 'view']) AS feature)
      SELECT feature, count(*) AS n_cells, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM u CROSS JOIN k LEFT JOIN counts c ON c.user_id = u.user_id AND c.event_type = k.feature GROUP BY feature""",
    "summary_file": f"WITH {PEAKS} SELECT run_id, count(*) AS n_peaks, max(summit_height) AS highest, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_bases FROM peaks GROUP BY run_id",
    "chromosome_order": f"WITH {CALLS}, n AS (SELECT DISTINCT chrom FROM calls WHERE chrom IS NOT NULL) SELECT chrom, row_number() OVER (ORDER BY coalesce(TRY_CAST(chrom AS INTEGER), 1000), chrom) AS place FROM n",
    "read_pileup": f"""WITH {_READS}, b AS (SELECT chrom, rev, i, substr(s, i, 1) AS base, ascii(substr(q, i, 1)) - 33 AS ql, CASE WHEN i <= 12 THEN p + i - 1 ELSE p + i - 1 - 2 + 3 END AS pos FROM reads, range(1, 33) r(i) WHERE i <= 12 OR i >= 15),
      s AS (SELECT chrom, pos, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'G') AS g, count(*) FILTER (rev) AS v FROM b WHERE ql >= 20 GROUP BY chrom, pos)
      SELECT chrom, count(*) AS n_sites, CAST(sum(depth) AS BIGINT) AS n_bases, max(depth) AS deepest, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(g) AS BIGINT) AS n_g, CAST(sum(v) AS BIGINT) AS n_reverse, CAST(sum(pos * depth) AS BIGINT) AS weighted FROM s GROUP BY chrom""",
    "read_methylation": f"""WITH {CALLS}, r AS (SELECT record_id, chrom, pos AS p, record_id % 2 = 0 AS rev, {sql_bases("CAST(record_id AS VARCHAR)")} AS s FROM calls WHERE chrom IS NOT NULL AND pos > 0),
      c AS (SELECT record_id, chrom, p, CASE WHEN rev THEN list_reverse(list_filter(range(1, 33), lambda i: s[i] = 'G')) ELSE list_filter(range(1, 33), lambda i: s[i] = 'C') END AS cs FROM r),
      m AS (SELECT chrom, p, cs[k] AS i, CASE k WHEN 2 THEN record_id % 200 WHEN 3 THEN 100 ELSE 50 END / 255.0 AS b FROM c, (SELECT unnest([2, 3, 5]) AS k) WHERE k <= len(cs))
      SELECT chrom, count(*) AS n_sites, CAST(sum(p - 1 + CASE WHEN i <= 12 THEN i - 1 ELSE i - 1 - 2 + 3 END) AS BIGINT) AS positions, round(avg(b * 100), 4) AS level FROM m WHERE i NOT IN (13, 14) GROUP BY chrom""",
    "read_lengths": f"WITH {_READS} SELECT rev AS is_reverse, count(*) AS n_reads, count(*) * 32 AS query, count(*) * 33 AS reference FROM reads GROUP BY rev",
}
