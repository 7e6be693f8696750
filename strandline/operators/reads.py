"""Aligned reads: CIGAR strings, pileups, genotypes, tumour against normal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flag bits of SAM: unmapped, reverse strand, secondary, duplicate, supplementary (fixed values).
UNMAPPED, REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 4, 16, 256, 1024, 2048
BASES = "ACGT"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text: name, flag, chrom, pos (1-based), mapq, cigar, seq, qual, and the tags mm and ml; headers left out."""
    part = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(F.split("value", "\t")) >= 11))
    found = rows.select(
        part(0).alias("name"), part(1).try_cast("int").alias("flag"), part(2).alias("chrom"), part(3).try_cast("long").alias("pos"), part(4).try_cast("int").alias("mapq"),
        part(5).alias("cigar"), part(9).alias("seq"), part(10).alias("qual"), "value",
    )
    return with_tags(found, "value").drop("value")


def usable_reads(reads: DataFrame, *, least_mapq: int = 20) -> DataFrame:
    """Mapped, primary reads that are no duplicates, of at least the mapping quality."""
    drop = UNMAPPED | SECONDARY | DUPLICATE | SUPPLEMENTARY
    return reads.filter((F.col("flag").bitwiseAND(F.lit(drop)) == 0) & (F.col("mapq") >= least_mapq) & (F.col("pos") > 0))


def cigar_operations(cigar: Column) -> Column:
    """Array of (n, op)."""
    n, op = F.expr, F.regexp_extract_all
    lengths, kinds = op(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), op(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lengths, kinds, lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("op")))


def query_length(cigar: Column) -> Column:
    """Bases of the read that the CIGAR takes up."""
    return F.aggregate(cigar_operations(cigar), F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that the CIGAR spans."""
    return F.aggregate(cigar_operations(cigar), F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(0))


def aligned_bases(reads: DataFrame, *, least_quality: int = 20) -> DataFrame:
    """One row a base aligned to the reference: chrom, pos, base, quality, is_reverse."""
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<q:int,r:int,n:int>>").alias("blocks"))

    def step(s: Column, o: Column) -> Column:
        matched, query, reference = o["op"].isin("M", "=", "X"), o["op"].isin("M", "I", "S", "=", "X"), o["op"].isin("M", "D", "N", "=", "X")
        blocks = F.when(matched, F.array_append(s["blocks"], F.struct(s["q"].alias("q"), s["r"].alias("r"), o["n"].alias("n")))).otherwise(s["blocks"])
        return F.struct((s["q"] + F.when(query, o["n"]).otherwise(0)).alias("q"), (s["r"] + F.when(reference, o["n"]).otherwise(0)).alias("r"), blocks.alias("blocks"))

    blocks = F.aggregate(cigar_operations(F.col("cigar")), start, step, lambda s: s["blocks"])
    spans = reads.withColumn("_x", F.explode(blocks)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_x.n") - 1)))
    at = F.col("_x.q") + F.col("_i") + 1
    quality = F.ascii(F.col("qual").substr(at, F.lit(1))) - 33
    bases = spans.select(
        "chrom", (F.col("pos") + F.col("_x.r") + F.col("_i")).alias("pos"), F.upper(F.col("seq").substr(at, F.lit(1))).alias("base"), quality.alias("quality"),
        (F.col("flag").bitwiseAND(F.lit(REVERSE)) != 0).alias("is_reverse"),
    )
    return bases.filter(F.col("quality") >= least_quality)


def pileup(bases: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Counts of each base and strand at each position; nothing is collected per site."""
    keys = by or ["chrom", "pos"]
    n = lambda b, name: F.count(F.when(b, 1)).alias(name)
    return bases.groupBy(*keys).agg(F.count("*").alias("depth"), *[n(F.col("base") == b, f"n_{b.lower()}") for b in BASES], n(F.col("is_reverse"), "n_reverse"))


def genotypes(bases: DataFrame, *, by: list[str], is_alt: Column, quality: Column, theta: float = 0.001) -> DataFrame:
    """The likeliest of the three genotypes of each site from its bases.

    With error e = 10 ** (-q / 10): a base that is not of the genotype's allele has
    likelihood e, one of a heterozygous site one half. Priors: 1 - 1.5 theta, theta,
    theta / 2. Result: depth, n_alt, genotype (0, 1, 2) and quality of the call.
    """
    error = F.pow(F.lit(10.0), -F.greatest(F.least(quality.cast("double"), F.lit(60.0)), F.lit(1.0)) / 10)
    rows = bases.withColumn("_alt", is_alt).withColumn("_e", error)
    ref = F.when(F.col("_alt"), F.log("_e")).otherwise(F.log(1 - F.col("_e")))
    alt = F.when(F.col("_alt"), F.log(1 - F.col("_e"))).otherwise(F.log("_e"))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("depth"), F.count(F.when(F.col("_alt"), 1)).alias("n_alt"), F.sum(ref).alias("_l0"), (F.count("*") * math.log(0.5)).alias("_l1"), F.sum(alt).alias("_l2")
    )
    priors = (math.log(1 - 1.5 * theta), math.log(theta), math.log(theta / 2))
    posterior = [F.col(f"_l{g}") + p for g, p in enumerate(priors)]
    scored = sums.select(*by, "depth", "n_alt", F.array(*posterior).alias("_p"))
    best = F.array_max("_p")
    other = F.array_max(F.filter("_p", lambda p: p < best))
    return scored.select(*by, "depth", "n_alt", (F.array_position("_p", best) - 1).cast("int").alias("genotype"), F.least(F.lit(999.0), 10 * (best - other) / math.log(10)).alias("quality"))


def genotype_likelihoods(bases: DataFrame, *, by: list[str], is_alt: Column, quality: Column) -> DataFrame:
    """Likelihoods of the three genotypes of each site, scaled by Phred, the likeliest being 0: depth, ``pl``."""
    error = F.pow(F.lit(10.0), -F.greatest(F.least(quality.cast("double"), F.lit(60.0)), F.lit(1.0)) / 10)
    rows = bases.withColumn("_alt", is_alt).withColumn("_e", error)
    ref = F.when(F.col("_alt"), F.log("_e")).otherwise(F.log(1 - F.col("_e")))
    alt = F.when(F.col("_alt"), F.log(1 - F.col("_e"))).otherwise(F.log("_e"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("depth"), F.array(F.sum(ref), F.count("*") * math.log(0.5), F.sum(alt)).alias("_l"))
    return sums.select(*by, "depth", F.transform("_l", lambda x: F.round(-10 * (x - F.array_max("_l")) / math.log(10)).cast("long")).alias("pl"))


def strand_bias(bases: DataFrame, *, by: list[str], is_alt: Column, is_reverse: Column, most: float = 10.8276) -> DataFrame:
    """Chi-square of allele by strand at each site, 0 where a side is empty, and whether it is above ``most`` (one in a thousand)."""
    n = lambda a, r: F.count(F.when((is_alt if a else ~is_alt) & (is_reverse if r else ~is_reverse), 1))
    t = bases.groupBy(*by).agg(n(True, True).alias("_a"), n(True, False).alias("_b"), n(False, True).alias("_c"), n(False, False).alias("_d"))
    a, b, c, d = (F.col(x) for x in ("_a", "_b", "_c", "_d"))
    sides = (a + b) * (c + d) * (a + c) * (b + d)
    odds = a * d - b * c
    found = t.select(*by, (a + b + c + d).alias("depth"), F.when(sides > 0, (a + b + c + d).cast("double") * odds * odds / sides).otherwise(0.0).alias("chi_square"))
    return found.withColumn("biased", F.col("chi_square") > most)


def contrast_sites(tumour: DataFrame, normal: DataFrame, *, on: list[str], least: float = 6.3, most_normal: float = 0.03) -> DataFrame:
    """Tumour sites scored against the normal: log-odds that the alternative is there at its
    own frequency rather than as errors of one in a thousand, and a verdict.

    Both have ``depth`` and ``n_alt``; sites missing in the normal are left out.
    """
    def odds(depth: Column, alt: Column) -> Column:
        f = F.greatest(F.lit(0.001), F.least(F.lit(0.999), alt / depth))
        return alt * F.log10(f / 0.001) + (depth - alt) * F.log10((1 - f) / 0.999)

    side = lambda df, p: df.select(*on, F.col("depth").alias(f"{p}_depth"), F.col("n_alt").alias(f"{p}_alt"))
    both = side(tumour, "t").join(side(normal, "n"), on)
    scored = both.withColumn("lod", odds(F.col("t_depth"), F.col("t_alt"))).withColumn("normal_part", F.col("n_alt") / F.col("n_depth"))
    verdict = F.when(F.col("lod") < least, "weak").when(F.col("normal_part") > most_normal, "in_normal").otherwise("pass")
    return scored.withColumn("verdict", verdict)


def with_tags(rows: DataFrame, line: str) -> DataFrame:
    """Adds ``mm`` and ``ml`` of a SAM line: the base modifications' places and their bytes."""
    tag = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return rows.withColumn("mm", tag(r"\tMM:Z:([^\t]*)")).withColumn("ml", F.transform(F.split(tag(r"\tML:B:C,([0-9,]+)"), ","), lambda x: x.try_cast("int")))


def methylation_calls(reads: DataFrame, *, least: float = 0.0) -> DataFrame:
    """5-methylcytosines of long reads: chrom, pos (1-based), ``probability``, is_reverse.

    Of ``mm`` the first clause for C+m counts: how many cytosines to skip before each
    modified one, in the read's own direction, so on reversed reads guanines from the
    end. Its probabilities are the bytes of ``ml`` behind those of the clauses
    before, over 255. Places come to the reference by the CIGAR; inserted and clipped
    ones are left out, as are places that the read does not have.
    """
    clauses = F.filter(F.split("mm", ";"), lambda c: c != "")
    is_m = lambda c: c.rlike(r"^C\+m[.?]?(,|$)")
    skips = lambda c: F.filter(F.transform(F.slice(F.split(c, ","), F.lit(2), F.size(F.split(c, ","))), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    first = F.array_position(F.transform(clauses, is_m), F.lit(True)).cast("int")
    rows = reads.withColumn("_first", first).filter(F.col("_first") > 0).withColumn("_clauses", clauses)
    rows = rows.withColumn("_skips", skips(F.element_at("_clauses", F.col("_first"))))
    rows = rows.withColumn("_before", F.aggregate(F.slice("_clauses", F.lit(1), F.col("_first") - 1), F.lit(0), lambda n, c: n + F.size(skips(c))))
    is_reverse = F.col("flag").bitwiseAND(F.lit(REVERSE)) != 0
    base = F.when(is_reverse, "G").otherwise("C")
    sites = F.filter(F.sequence(F.lit(1), F.length("seq")), lambda i: F.upper(F.col("seq")).substr(i, F.lit(1)) == F.col("_base"))
    rows = rows.filter(F.length("seq") > 0).withColumn("_base", base).withColumn("_sites", sites)
    rows = rows.withColumn("_sites", F.when(is_reverse, F.reverse("_sites")).otherwise(F.col("_sites")))
    # Each modified cytosine's number among all: the skips so far and the modified ones before.
    numbers = F.transform("_skips", lambda _, i: F.aggregate(F.slice("_skips", F.lit(1), i + 1), F.lit(0), lambda n, x: n + x) + i + 1)
    places = rows.withColumn("_numbers", numbers).select("*", F.posexplode("_numbers").alias("_i", "_number"))
    at = F.when(F.col("_number") <= F.size("_sites"), F.get("_sites", F.col("_number") - 1))
    placed = places.withColumn("_at", at).withColumn("probability", F.get("ml", F.col("_before") + F.col("_i")) / 255.0).filter(F.col("_at").isNotNull() & F.col("probability").isNotNull())
    start = F.struct(F.lit(1).alias("q"), F.lit(0).alias("r"), F.lit(None).cast("int").alias("found"))

    def step(s: Column, o: Column) -> Column:
        query, reference = o["op"].isin("M", "=", "X", "I", "S"), o["op"].isin("M", "=", "X", "D", "N")
        here = o["op"].isin("M", "=", "X") & (F.col("_at") >= s["q"]) & (F.col("_at") < s["q"] + o["n"])
        found = F.when(here, s["r"] + F.col("_at") - s["q"]).otherwise(s["found"])
        return F.struct((s["q"] + F.when(query, o["n"]).otherwise(0)).alias("q"), (s["r"] + F.when(reference, o["n"]).otherwise(0)).alias("r"), found.alias("found"))

    shift = F.aggregate(cigar_operations(F.col("cigar")), start, step, lambda s: s["found"])
    found = placed.withColumn("_shift", shift).filter(F.col("_shift").isNotNull() & (F.col("probability") >= least))
    return found.select("chrom", (F.col("pos") + F.col("_shift")).alias("pos"), "probability", is_reverse.alias("is_reverse"))


def methylation_rows(found: DataFrame) -> DataFrame:
    """Calls as methylation sites: chrom, start_pos (0-based), end_pos, methylation in per cent, no gene."""
    return found.select("chrom", (F.col("pos") - 1).alias("start_pos"), F.col("pos").alias("end_pos"), (F.col("probability") * 100).alias("methylation"), F.lit(None).cast("string").alias("gene"))
