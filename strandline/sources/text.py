"""Readers of the line-based formats: VCF, expression tables, BED, narrowPeak, GMT, GTF, FASTA, FASTQ, 10x.

All are column expressions over ``spark.read.text`` (gzip comes for free); nothing
is read on the driver but a header line where the format names its columns there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.loading import good_records, parse_lines, rejected_lines
from strandline.operators.ordering import running
from strandline.session import checkpointed

#: Copy-number types named by a VCF's SVTYPE, and the copies inferred for them (fixed values).
CNV_TYPES = {"CNV": 2, "DEL": 1, "DUP": 3, "GAIN": 3, "LOSS": 1}


def info_field(info: Column, key: str) -> Column:
    """The value of the first ``key=`` of an INFO string; null without one."""
    value = F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(value != "", value)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).filter(F.col("line") != "")


def _header(spark: SparkSession, path: str) -> str:
    """The first line that is not empty, of the first file by name; '' without one."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    name = lines.agg(F.min("_metadata.file_path")).first()[0]
    first = spark.read.text(name).filter(F.col("value") != "").first() if name else None
    return first[0].rstrip("\r") if first else ""


def _part(i: int) -> Column:
    return F.get(F.split("line", "\t"), F.lit(i))


def _try(column: Column, kind: str) -> Column:
    return column.try_cast(kind)


def _whole(column: Column) -> Column:
    """Digits only, as a long; otherwise null."""
    return F.when(column.rlike("^[0-9]+$"), _try(column, "long"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant calls: seven columns and an optional INFO. A QUAL of ``.`` is 0; AF is
    the first item of AF, else AF1; the gene that of GENE, Gene or ANN's fourth part.
    Lines with a bad position or too few columns are left out."""
    rows = _lines(spark, path).filter(~F.col("line").startswith("#"))
    info = F.coalesce(_part(7), F.lit(""))
    frequency = F.split(F.coalesce(info_field(info, "AF"), info_field(info, "AF1")), ",")[0]
    annotated = F.get(F.split(info_field(info, "ANN"), r"\|"), F.lit(3))
    gene = F.coalesce(info_field(info, "GENE"), info_field(info, "Gene"), F.when(annotated != "", annotated))
    parsed = rows.filter(F.size(F.split("line", "\t")) >= 7).select(
        _part(0).alias("chrom"),
        _whole(_part(1)).alias("pos"),
        _part(3).alias("ref_allele"),
        _part(4).alias("alt_allele"),
        F.when(_part(5) == ".", 0.0).otherwise(_try(_part(5), "float")).cast("float").alias("qual"),
        _part(6).alias("filter_status"),
        _try(frequency, "float").alias("af"),
        gene.alias("gene"),
    )
    return parsed.filter(F.col("pos").isNotNull())


def read_cnv_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Copy-number records: those with CN, CNA or TCN, or an SVTYPE of its kind."""
    rows = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.size(F.split("line", "\t")) >= 8))
    info = _part(7)
    kind = F.upper(info_field(info, "SVTYPE"))
    stated = _try(F.coalesce(info_field(info, "CN"), info_field(info, "CNA"), info_field(info, "TCN")), "float")
    inferred = F.coalesce(*[F.when(kind == k, float(v)) for k, v in CNV_TYPES.items()])
    start = _whole(_part(1))
    return rows.select(
        _part(0).alias("chrom"),
        start.alias("start_pos"),
        F.coalesce(_whole(info_field(info, "END")), start + 1).alias("end_pos"),
        F.coalesce(stated, inferred).cast("float").alias("copy_number"),
        F.coalesce(info_field(info, "GENE"), info_field(info, "Gene")).alias("gene"),
        _try(F.coalesce(info_field(info, "LOG2"), info_field(info, "RATIO")), "float").alias("log2_ratio"),
    ).filter(F.col("start_pos").isNotNull() & F.col("copy_number").isNotNull())


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """An expression table in long form: gene_id, sample_id, sample_no, value.

    The header names the samples; bad or missing cells are 0, further ones are
    ignored, rows without a gene are left out."""
    header = _header(spark, path)
    samples = F.array(*[F.lit(n.strip()) for n in header.split("\t")[1:]]).cast("array<string>")
    rows = _lines(spark, path).filter(F.col("line") != F.lit(header)).withColumn("gene_id", F.trim(_part(0))).filter(F.col("gene_id") != "")
    cells = rows.select("gene_id", F.split("line", "\t").alias("_c"), F.posexplode(samples).alias("_i", "sample_id"))
    value = F.coalesce(_try(F.trim(F.get("_c", F.col("_i") + 1)), "double"), F.lit(0.0))
    return cells.select("gene_id", "sample_id", (F.col("_i") + 1).alias("sample_no"), value.alias("value"))


def read_methylation(spark: SparkSession, path: str) -> DataFrame:
    """Methylation sites of a BED file: with five columns the score over ten, with four
    a value that counts as per cent above 1 and as a fraction otherwise; 0 to 100. The
    fourth column is a gene only before a fifth, and unless it is a number."""
    rows = _lines(spark, path).filter(~F.col("line").rlike("^(?:#|track|browser)"))
    n = F.size(F.split("line", "\t"))
    number = _try(_part(3), "double")
    raw = F.when(n >= 5, _try(_part(4), "double") / 10).when(n == 4, F.when(number > 1, F.least(number, F.lit(100.0))).otherwise(number * 100))
    return rows.select(
        _part(0).alias("chrom"),
        _whole(_part(1)).alias("start_pos"),
        _whole(_part(2)).alias("end_pos"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("methylation"),
        F.when((n >= 5) & number.isNull(), _part(3)).alias("gene"),
        raw.isNotNull().alias("_ok"),
    ).filter(F.col("_ok") & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()).drop("_ok")


def read_checked(spark: SparkSession, path: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """Good records and failing lines of a narrowPeak, VCF or GMT file."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.lit(fmt).alias("fmt"), F.col("value").alias("line_text"))
    parsed = parse_lines(rows)
    return good_records(parsed, fmt), rejected_lines(parsed)


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets: name, description, genes in upper case without empty ones."""
    rows = _lines(spark, path).filter(~F.col("line").startswith("#"))
    parts = F.split("line", "\t")
    genes = F.filter(F.transform(F.slice(parts, 3, F.size(parts)), lambda g: F.upper(F.trim(g))), lambda g: g != "")
    return rows.filter(F.size(parts) >= 2).select(_part(0).alias("set_name"), _part(1).alias("description"), genes.alias("genes"))


def _attribute(key: str) -> Column:
    """A GTF (key "v";) or GFF3 (key=v;) attribute."""
    value = F.coalesce(F.nullif(F.regexp_extract(_part(8), rf'{key} "([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(_part(8), rf"(?:^|;)\s*{key}=([^;]*)", 1), F.lit("")))
    return value


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF3 features, positions 0-based and half-open."""
    rows = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.size(F.split("line", "\t")) >= 9))
    return rows.select(
        _part(0).alias("chrom"),
        _part(2).alias("feature"),
        (_whole(_part(3)) - 1).alias("start_pos"),
        _whole(_part(4)).alias("end_pos"),
        _part(6).alias("strand"),
        _attribute("gene_id").alias("gene_id"),
        _attribute("gene_name").alias("gene_name"),
        _attribute("transcript_id").alias("transcript_id"),
    ).filter(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())


def gene_spans(features: DataFrame) -> DataFrame:
    """From the features, each gene from its first start to its last end."""
    rows = features.filter(F.col("feature").isin("gene", "exon") & F.col("gene_id").isNotNull())
    return rows.groupBy("gene_id").agg(
        F.min("chrom").alias("chrom"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("gene_name").alias("gene_name"), F.min("strand").alias("strand")
    )


def splice_junctions(features: DataFrame) -> DataFrame:
    """Pairs of neighbouring exons of a transcript that do not overlap: donor and acceptor."""
    order = W.partitionBy("transcript_id").orderBy("start_pos", "end_pos")
    exons = features.filter((F.col("feature") == "exon") & F.col("transcript_id").isNotNull())
    paired = exons.withColumn("acceptor", F.lead("start_pos").over(order))
    return paired.filter(F.col("acceptor") > F.col("end_pos")).select("chrom", "transcript_id", F.col("end_pos").alias("donor"), "acceptor", "strand")


def read_fasta(spark: SparkSession, path: str, *, only_bases: bool = False) -> DataFrame:
    """Sequences by name (the header's first word), in upper case. With ``only_bases``
    all but A, C, G and T becomes N. Records are split by Spark at lines that begin with ``>``."""
    rows = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^[\s>]*(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    bases = F.regexp_replace(body, "[^ACGT]", "N") if only_bases else body
    return rows.select(head.alias("name"), bases.alias("sequence")).filter(F.col("sequence") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 1: ``line``, ``line_no``; several files or the parts
    of a folder are one text, in the order of their names.

    Within each block of a file the reader's order counts, and the blocks' offsets come
    from their sizes; there is one row a block, so no task sees more than its own lines.
    """
    place = ["_file", "_start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    sizes = lines.groupBy(*place).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(F.lit(0)).orderBy(*place).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*place, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return lines.join(offsets, place).select("line", (F.col("_offset") + F.col("_at") - F.col("_first") + 1).alias("line_no"))


def read_fasta_tiles(spark: SparkSession, path: str, *, width: int, margin: int, names: list[str] | None = None) -> DataFrame:
    """Sequences of any length as tiles (chrom, tile, bases) like those of ``sequence_tiles``,
    of the sequences with the given ``names`` only.

    Lines are placed by the running sum of their lengths, so a chromosome is never
    one row; a tile is put together from the pieces of the lines it touches, and is
    blank where the sequence has no base.
    """
    lines = numbered_lines(spark, path).withColumn("_i", F.col("line_no") - 1).withColumn("line", F.trim(F.regexp_replace("line", "\r$", "")))
    is_head = F.col("line").startswith(">")
    size = F.when(is_head, 0).otherwise(F.length("line"))
    placed = running(running(lines, [], size, "_sum", inclusive=False), [], F.when(is_head, F.col("line_no")), "_head", F.max)
    placed = checkpointed(placed.select("line", "_head", F.coalesce("_sum", F.lit(0)).alias("_sum")))
    heads = placed.filter(F.col("line").startswith(">")).select("_head", F.regexp_extract("line", r"^>\s*(\S+)", 1).alias("chrom"), F.col("_sum").alias("_base"))
    heads = heads.filter(F.col("chrom").isin(names)) if names is not None else heads
    rows = placed.filter(~F.col("line").startswith(">") & (F.col("line") != "")).join(heads, "_head").select("chrom", (F.col("_sum") - F.col("_base")).alias("_at"), F.upper("line").alias("_s"))
    # A piece of a line goes to every tile whose stretch, margins included, it touches.
    first, last = F.floor((F.col("_at") - margin) / width), F.floor((F.col("_at") + F.length("_s") - 1 + margin) / width)
    pieces = rows.withColumn("tile", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    start = F.col("tile") * width - margin
    begin = F.greatest(start, F.col("_at"))
    end = F.least(start + width + 2 * margin, F.col("_at") + F.length("_s"))
    cut = pieces.filter(begin < end).select("chrom", "tile", (begin - start).alias("_o"), F.col("_s").substr((begin - F.col("_at") + 1).cast("int"), (end - begin).cast("int")).alias("_p"), (F.col("_at") + F.length("_s")).alias("_to"))
    whole = cut.groupBy("chrom", "tile").agg(F.sort_array(F.collect_list(F.struct("_o", "_p"))).alias("_x"), F.max("_to").alias("_to")).filter(F.col("_to") > F.col("tile") * width)
    lead = F.repeat(F.lit(" "), F.col("_x")[0]["_o"].cast("int"))
    return whole.select("chrom", "tile", F.rpad(F.concat(lead, F.array_join("_x._p", "")), width + 2 * margin, " ").alias("bases"))


def fastq_quality(spark: SparkSession, path: str) -> DataFrame:
    """Reads, bases, mean length, GC and Q30 percentages of FASTQ records in one row.

    A record is four lines; bases are the second of them, qualities the fourth.
    """
    lines = numbered_lines(spark, path).withColumn("_k", (F.col("line_no") - 1) % 4)
    bases, quality = F.col("_k") == 1, F.col("_k") == 3
    sums = lines.agg(
        F.count(F.when(bases, 1)).alias("n_reads"),
        F.coalesce(F.sum(F.when(bases, F.length(F.rtrim("line")))), F.lit(0)).alias("n_bases"),
        F.sum(F.when(bases, F.length(F.regexp_replace(F.upper("line"), "[^GC]", "")))).alias("_gc"),
        F.sum(F.when(quality, F.length(F.regexp_replace("line", r"[\s!->]", "")))).alias("_q"),
    )
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n_bases")), F.lit(0.0))
    return sums.select("n_reads", "n_bases", F.coalesce(F.try_divide("n_bases", "n_reads"), F.lit(0.0)).alias("mean_length"), pct("_gc").alias("gc_pct"), pct("_q").alias("q30_pct"))


def read_mex(spark: SparkSession, directory: str, *, names: dict[str, str] | None = None) -> DataFrame:
    """A 10x matrix directory in long form: barcode, feature, n (or its three parts by ``names``).

    Barcodes and features are numbered by their lines (second column of the features
    if there is one, else the first)."""

    places = names or {name: f"{directory}/{name}*" for name in ("barcodes", "features", "matrix")}

    def numbered(name: str, column: Column) -> DataFrame:
        return numbered_lines(spark, places[name]).select(column.alias(name), F.col("line_no").alias("_no"))

    cells = numbered("barcodes", F.trim("line")).select(F.col("barcodes").alias("barcode"), F.col("_no").alias("cell_no"))
    parts = F.split("line", "\t")
    features = numbered("features", F.coalesce(F.get(parts, F.lit(1)), parts[0])).select(F.col("features").alias("feature"), F.col("_no").alias("feature_no"))
    entries = numbered_lines(spark, places["matrix"]).filter(~F.col("line").startswith("%"))
    split = F.split(F.trim("line"), r"\s+")
    rows = entries.select(split[0].cast("long").alias("feature_no"), split[1].cast("long").alias("cell_no"), split[2].cast("long").alias("n"), F.col("line_no").alias("_at"))
    # The first line that is no comment holds the dimensions.
    first = rows.agg(F.min("_at").alias("_first"))
    return rows.crossJoin(first).filter(F.col("_at") > F.col("_first")).join(cells, "cell_no").join(features, "feature_no").select("barcode", "feature", "n")


def read_counts_table(spark: SparkSession, path: str) -> DataFrame:
    """A matrix of counts with a header (tab or comma, whichever the header has) in long
    form: row, feature, n. Bad and missing cells are 0; rows without a name are left out."""
    head = _header(spark, path)
    mark = "\t" if "\t" in head else ","
    names = F.array(*[F.lit(n.strip()) for n in head.split(mark)[1:]]).cast("array<string>")
    cells = _lines(spark, path).filter(F.col("line") != F.lit(head)).withColumn("_c", F.split("line", mark)).withColumn("row", F.trim(F.get("_c", F.lit(0)))).filter(F.col("row") != "")
    long = cells.select("row", "_c", F.posexplode(names).alias("_i", "feature"))
    return long.select("row", "feature", F.coalesce(_try(F.trim(F.get("_c", F.col("_i") + 1)), "double"), F.lit(0.0)).alias("n"))


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Positions of spots in tissue (barcode, in_tissue, row, column, y, x): barcode, x, y.
    A header that begins with ``barcode`` is left out; commas or tabs part the fields."""
    parts = F.split("line", "[,\t]")
    rows = _lines(spark, path).filter(~F.lower("line").startswith("barcode") & (F.size(parts) >= 6))
    number = lambda i: _try(F.trim(parts[i]), "double")
    spots = rows.select(F.trim(parts[0]).alias("barcode"), number(5).alias("x"), number(4).alias("y"), number(1).alias("_in"))
    return spots.filter((F.col("_in") != 0) & F.col("x").isNotNull() & F.col("y").isNotNull()).drop("_in")


def read_spot_counts(spark: SparkSession, positions: str, matrix: str) -> DataFrame:
    """Spots in tissue with the total of their counts: a positions file and a 10x matrix directory."""
    totals = read_mex(spark, matrix).groupBy("barcode").agg(F.sum("n").alias("total"))
    return read_spots(spark, positions).join(totals, "barcode", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def read_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Summaries written as JSON, one document a line, of a given schema; what does not fit is null."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("_s")).select("_s.*")
